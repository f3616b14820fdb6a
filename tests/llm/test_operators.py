"""Each operator against a brute-force version on a small table with nulls, empty and long texts, ties, repeated rows and
columns that clash with what the operators add; and on an empty table."""

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard, jpeg, langid, lempel_ziv, lines, media, mixing, packing, repeats, shingles, tokens, toxicity
from ledgerloom.llm.shingles import shingle_sets

PASSAGE = "the committee met on a grey morning and resolved, after some debate, that the bridge should be closed for repairs until spring"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
LINES = "first line of the shared part has words\nsecond line of the shared part too\nthird line closes it all now"
TEXTS = [
    "one two three four five six seven", "one two three four five six seven", "One  two three FOUR five six seven eight nine ten", None, "", " \n ", "x", "a" * 200, "a" * 130, PASSAGE,
    f"intro {PASSAGE} outro", f"another {PASSAGE}", f"{PASSAGE} {PASSAGE}", LONG, LONG + " end", LINES, f"top\n{LINES}\nbottom", f"{LINES}\n\n{LINES}", "été à la plage <|endoftext|> it's 12", "日本語 テキスト　です",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if t else None, f"s{i % 4}" if i % 5 else None, len(t or ""), 1, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[9], (None, "no id here", "en", "s1", 10, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, _range string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def distinct():
    return dict(enumerate(TEXTS)) | {None: "no id here"}


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    got = rows_by_id(tokens.token_counts(docs, path))
    assert len(got[0]) == 2
    for i, t in distinct().items():
        assert {(r["n_bytes"], r["n_tokens"]) for r in got[i]} == {(len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False)))}
    assert tokens.token_counts(empty, path).count() == 0


def test_chunks_encode_as_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    alphabet = [*" \n\t\x1c\x85\xa0　'sS tdaé1²!<|>Σς.", "<|endoftext|>", "it's ", "the "]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 50))) for _ in range(800)]
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(tokens, "SLICE", 16)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        want = [np.array(e.ids, np.uint32).tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert list(tokens.encoded(texts, tokens.ChunkEncoder(path, False))) == want
    ranks = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    quick = tokens.ChunkEncoder(path, False, ranks)
    assert quick.quick and list(tokens.encoded(texts, quick)) == want
    assert tokens.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), False, ranks).quick is None
    assert tokens.ChunkEncoder(path, False, (ranks[0], ranks[1] + "x")).quick is None
    assert tokens.ChunkEncoder(path, False, (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ranks[1])).quick is None


def test_ranks_merge_as_the_tokenizer_file_does():
    """For every token of the vocabulary the merges of lower rank leave just the two parts that the file merges last, so
    whatever the text, both ways merge the same; and for every character both split in the same places."""
    import json

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ranks = tokens.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert tokens.same_merges(path, ranks, public_tokenizers.PATTERN)
    letters = tokens.byte_letters()
    for merge in json.load(open(path, encoding="utf-8"))["model"]["merges"]:
        left, right = (bytes(letters[c] for c in x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
        parts, rank = [bytes([x]) for x in left + right], ranks[left + right]
        while True:
            joined = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            if min(joined, default=rank) >= rank:
                break
            at = joined.index(min(joined))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert parts == [left, right]
    quick = tokens.ChunkEncoder(path, False, (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)).quick
    known = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1 {c} {c}{c}.{c}'s\n" for c in known[i : i + 256]) for i in range(0, len(known), 256)]
    whole = Tokenizer.from_file(path)
    for i in range(0, len(texts), 500):
        assert [e.ids for e in whole.encode_batch(texts[i : i + 500], add_special_tokens=False)] == [quick(x) for x in texts[i : i + 500]]


def near_classes(texts, words, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates(spark, docs, empty):
    got = rows_by_id(jaccard.near_duplicates(docs, 4, 85))
    want = near_classes({i: t for i, t in distinct().items() if i is not None}, 4, 85)
    assert {i: {(r["n_shingles"], r["component_id"]) for r in own} for i, own in got.items() if i is not None} == {i: {v} for i, v in want.items()}
    assert got[None][0]["component_id"] is None
    assert jaccard.near_duplicates(empty).count() == 0
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    group = {}
    for i in range(120):  # near copies about the threshold, in two families
        own = [w if rng.random() > 0.02 * (i % 4) else f"e{rng.integers(0, 40)}" for w in (base if i % 2 else base[::-1])]
        group[i] = " ".join(own)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(list(group.items()), "doc_id long, text string"), 2, 80).collect()}
    assert got == near_classes(group, 2, 80)


def test_no_linked_pair_lacks_a_common_signature():
    rng = np.random.default_rng(0)
    for trial in range(60):
        percent, base = (80, 85, 90)[trial % 3], rng.integers(0, 2**63, int(rng.integers(2, 300)), dtype=np.uint64)
        sets = [np.unique(np.append(base[rng.random(base.size) > rng.random() * 0.12], rng.integers(0, 2**63, int(rng.integers(0, base.size // 12 + 1)), dtype=np.uint64))) for _ in range(8)]
        marks = [set(jaccard.signatures(s, (2 + s % np.uint64(7) * np.uint64(trial % 2) + np.uint64(trial % 4)).astype(np.uint8), percent).tolist()) for s in sets]
        for a in range(8):
            for b in range(a):
                shared = np.intersect1d(sets[a], sets[b]).size
                if shared and 100 * shared >= percent * (sets[a].size + sets[b].size - shared) and not np.array_equal(sets[a], sets[b]):
                    assert marks[a] & marks[b]


def lz_phrases(text):
    seen, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen | ({(phrase, "end")} if phrase else set())


def test_dictionaries_are_emptied_when_full(monkeypatch):
    rng = np.random.default_rng(14)
    text = "".join(rng.choice(list("abcdefgh"), 4000))
    other = "".join(rng.choice(list("abcdefgh"), 1300))
    whole = lempel_ziv.fingerprint(text)
    monkeypatch.setattr(lempel_ziv, "PHRASES", 100)
    hashes, start = set(), 0
    while start < len(text):  # a parser of its own up to where its dictionary is emptied
        parser = lempel_ziv.Parser()
        for end in range(start, len(text)):
            parser.parse(text[end])
            if parser.found:
                break
        hashes.update(parser.phrases())
        start = end + 1
    got = lempel_ziv.fingerprint(text)
    assert np.array_equal(got, lempel_ziv.signature(sorted(hashes))) and not np.array_equal(got, whole)
    for kept in (0, 10, 2700, 4000):
        own, edited = lempel_ziv.both_fingerprints(text, kept, other)
        assert np.array_equal(own, got) and np.array_equal(edited, lempel_ziv.fingerprint(text[:kept] + other))
    assert lempel_ziv.fingerprint("a").tolist() != lempel_ziv.fingerprint("aa").tolist()


def test_phrase_fingerprints(spark, docs, empty):
    texts = {i: t or "" for i, t in enumerate(TEXTS) if i not in (0, 9)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in lempel_ziv.edited_fingerprints(frame).collect()}
    order = sorted(texts, reverse=True)
    for i, following in zip(order, [*order[1:], order[0]], strict=True):
        text, m = texts[i], len(texts[i]) // 3
        edited = text[: len(text) - m] + texts[following][:m]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["edited_fingerprint"] == lempel_ziv.as_text(lempel_ziv.fingerprint(edited)) and r["fingerprint"] == lempel_ziv.as_text(lempel_ziv.fingerprint(text))
        a, b = lz_phrases(text), lz_phrases(texts[following])
        if len(a | b) < lempel_ziv.SIGNATURE:
            assert r["near_next"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert got[7]["fingerprint"] != got[8]["fingerprint"] and got[4]["near_edited"] == 1.0
    assert lempel_ziv.edited_fingerprints(docs).count() == len(TEXTS) + 3 and lempel_ziv.edited_fingerprints(empty).count() == 0
    single = lempel_ziv.edited_fingerprints(frame.where("doc_id = 1")).first()
    assert single["near_next"] == 1.0


def kept_bytes(texts):
    first, out = {}, {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            if first.setdefault(data[p : p + 50], i) < i:
                gone[p : p + 50] = True
        out[i] = bytes(np.frombuffer(data, np.uint8)[~gone]), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
    return out


def test_repeats(spark, docs, empty):
    got = rows_by_id(repeats.remove_repeats(docs))
    for i, (kept, removed, spans) in kept_bytes(dict(enumerate(TEXTS))).items():
        assert {(bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in got[i]} == {(kept, removed, spans)}
    assert repeats.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [1, 3, 17])
def test_repeats_of_passages_in_many_contexts(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    for module in (repeats, shingles):
        monkeypatch.setattr(module, "BLOCK", 128)
    monkeypatch.setattr(shingles, "powers", shingles.powers.__wrapped__)
    rng = np.random.default_rng(2)
    parts = ["".join(rng.choice(list("abcde "), 90)) for _ in range(5)]
    made = {i: "".join(parts[rng.integers(0, 5)][rng.integers(0, 30) : rng.integers(50, 90)] for _ in range(rng.integers(0, 7))) for i in range(80)}
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()}
    assert got == kept_bytes(made)


def test_run_length_index_is_a_burrows_wheeler_transform():
    texts = [b"mississippi" * 9, b"sip of misc" * 9, b"abc" * 20]
    index = repeats.RunLengthIndex.build(texts, np.array([0, 1, 2]))
    whole = b"\0".join(texts) + b"\0"
    rows, steps = np.arange(3), []
    for _ in range(5):
        rows = index.step(rows)
        steps.append(rows.copy())
    rank = {p: r for r, p in enumerate(sorted(range(len(whole)), key=lambda p: (whole[p : whole.index(0, p)], whole[:p].count(0))))}
    assert rank  # suffixes closed by ordered terminators
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    order = sorted(range(len(whole)), key=lambda p: ([c + 1 for c in whole[p : whole.index(0, p)]] + [0], whole[:p].count(0)))
    for k, row in enumerate(steps, 1):
        assert [order[r] for r in row] == (ends - k).tolist()
    assert index.head.size == index.run_start.size < len(whole)


def test_language(spark, docs, empty):
    rng = np.random.default_rng(1)
    words = {"aa": ["tah", "ohm", "reth", "ing", "shou"], "bb": ["lez", "oix", "que", "eau", "tre"], "cc": ["ungs", "schk", "ber", "ach", "der"]}
    made = [(i, " ".join(rng.choice(words[k], 30)), k) for i, k in enumerate(list(words) * 60)]
    df = spark.createDataFrame([*made, (900, None, "aa"), (901, "12 !?", "aa"), (None, "tah ohm", "aa"), (902, "tah reth ohm", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.identified(df).collect()}
    held = [r for i, r in got.items() if r["held_out"] and i is not None and i < 900]
    assert held and all(r["lang_pred"] == made[r["doc_id"]][2] and 0 <= r["score"] <= 1 for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "aa" and got[None]["lang_pred"] == "aa"
    assert langid.identified(empty).count() == 0 and langid.identified(docs).count() == len(TEXTS) + 3
    assert {r["lang_pred"] for r in langid.identified(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_many_languages_are_all_learned(spark):
    rng = np.random.default_rng(4)
    words = {f"l{i:03}": ["".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz"], 6)) for _ in range(12)] for i in range(300)}
    rows = [(300 * k + i, " ".join(rng.choice(own, 30)), lang if k else None) for k in range(3) for i, (lang, own) in enumerate(words.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, F.lit(True))
    assert model.languages == sorted(words)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df.where("lang is null"), model).collect()}
    assert got == dict(enumerate(words))


def test_cross_parsing_counts_greedy_phrases():
    sample, text = b"abracadabra", b"abraabcadzbrac"
    automaton = langid.Automaton.of(bytes(c - 96 for c in sample), 30)
    model = langid.Model(["x"], bytes(c - 96 if 97 <= c < 123 else 0 for c in range(256)), [automaton], [1.0])
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample and text[at:end] in sample:
            end += 1
        count, at = count + 1, end
    assert abs(int(model.phrases([text])[0, 0]) - count) <= 1


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(4)
    calm = ["river", "window", "paper", "garden", "evening", "music", "bread", "stone", "letter", "winter"]
    made = []
    for i in range(500):
        words = list(rng.choice(calm, 60))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.integers(0, 60)] = rng.choice(["dreadfulfool", "nastyworm"])
        made.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame([(a, b) for a, b, _ in made] + [(900, None), (901, ""), (902, "you nastywurm of a river"), (903, "bread " * 500), (None, "garden")], "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(a, c, 1) for a, _, c in made] + [(None, 1, 0)], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in toxicity.scored(df, labels).collect()}
    held = [r for i, r in got.items() if r["held_out"] and i is not None and i < 500]
    assert held and all(r["predicted"] == made[r["doc_id"]][2] for r in held)
    assert got[902]["predicted"] == 1 and got[900]["score"] == got[901]["score"] and got[903]["predicted"] == 0 and got[None]["predicted"] == 0
    assert toxicity.scored(empty, labels).count() == 0
    none = toxicity.scored(docs, labels.where("false")).collect()
    assert len(none) == len(TEXTS) + 3 and {r["predicted"] for r in none} == {0}


def repeated_lines(texts):
    """Which of each text's lines that are not blank lie in a run of eight words and more that occurred before."""
    earlier, out = set(), []
    for text in texts:
        own, gone = [x.strip() for x in (text or "").split("\n") if x.strip()], set()
        for begin in range(len(own)):
            for end in range(begin + 1, len(own) + 1):
                run = tuple(own[begin:end])
                if sum(len(x.split()) for x in run) >= 8:
                    if run in earlier:
                        gone |= set(range(begin, end))
                    earlier.add(run)
        out.append((len(own), len(gone)))
    return out


def test_lines(docs, empty):
    out = rows_by_id(lines.dedup_lines(docs))
    want = dict(zip([None, *range(len(TEXTS))], repeated_lines(["no id here", *TEXTS]), strict=True))
    for i, own in out.items():
        assert {(r["n_lines"], r["n_removed"]) for r in own} == {want[i]}
    assert out[16][0]["text"] == "top\nbottom" and out[17][0]["n_removed"] == 6 and out[15][0]["text"] == LINES and out[3][0]["text"] is None
    assert set(lines.dedup_lines(docs).columns) == {*docs.columns, "n_lines", "n_removed"}
    assert lines.dedup_lines(empty).count() == 0


def test_a_copy_goes_whole_beside_a_rival(spark):
    """Three documents; the third copies the second, and the first shares some lines with both."""
    rng = np.random.default_rng(21)
    made = []
    for i in range(40):
        own = [" ".join(f"g{i}l{k}w{j}" for j in range(int(rng.integers(2, 9)))) for k in range(3)]
        first = [x if rng.random() < 0.67 else f"other {i} {k}" for k, x in enumerate(own)]
        made += ["\n".join(first), "\n".join(own), "\n".join(own)]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)).collect()}
    assert got == dict(enumerate(repeated_lines(made)))


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by sharing out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("shard_rows", [512, 20])
def test_mix(spark, docs, empty, monkeypatch, shard_rows):
    monkeypatch.setattr(mixing, "SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(6)
    made = [(i, "w " * int(rng.integers(0, 300)), None if i % 11 == 0 else f"s{int(rng.integers(0, 7)) ** 2}") for i in range(1500)]
    df = spark.createDataFrame([*made, (7, None, "s1"), (8, "a b", "s1"), (8, "a b", "s1")], "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    got = mixing.mix(df).collect()
    assert len(got) == 1503
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    want = filled(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 400 for s in want)
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs).count() == len(TEXTS) + 3


def test_apportionment(spark):
    rng = np.random.default_rng(8)
    for seats in (0, 1, 7, 200):
        votes = {i: int(v) for i, v in enumerate(rng.integers(0, 1000, 9))}
        heap = sorted(((-v / (2 * k - 1), i) for i, v in votes.items() if v for k in range(1, seats + 1)))[:seats]
        df = spark.createDataFrame([(i, float(v)) for i, v in votes.items()], "i long, v double").withColumn("n", F.lit(seats).cast("long"))
        got = {r["i"]: r["quota"] for r in mixing.apportion(df, [], ["i", "v"], "v", "n", ["i"]).collect()}
        assert got == {i: sum(x == i for _, x in heap) for i in votes}


def test_media(docs, empty):
    got = rows_by_id(media.media_digest(media.store_payload(docs)))
    for i, t in distinct().items():
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert {(r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got[i]} == {(len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))}
    assert got[0][0]["feature"] == got[1][0]["feature"] and got[0][0]["media_sha256"] == got[1][0]["media_sha256"]
    tensors = rows_by_id(media.decode_media(media.store_payload(docs)))
    assert all(len(r["rgb"]) == r["width"] * r["height"] * 3 for own in tensors.values() for r in own)
    assert media.media_digest(media.store_payload(empty)).count() == 0


def scan_bits(blocks, first, last, high, low):
    """A plain entropy coder for one AC scan of one component: (symbol, bits) in order."""
    out, runs = [], 0

    def flush(pending):
        nonlocal runs
        if runs:
            n = runs.bit_length() - 1
            out.append((n << 4, f"{runs - (1 << n):0{n}b}" if n else ""))
            out.append((None, pending))
            runs = 0
        return ""

    pending = ""
    for block in blocks:
        run, kept = 0, ""
        scan = [int(block[jpeg.ZIGZAG[k]]) for k in range(first, last + 1)]
        value = [(abs(v) >> low) * (1 if v > 0 else -1) for v in scan]
        alive = [i for i, v in enumerate(value) if (abs(v) == 1 if high else v)]
        end = alive[-1] if alive else -1
        for i, v in enumerate(value):
            if high and abs(v) > 1:
                kept += str(abs(v) & 1)
            elif not v:
                run += 1
            if i <= end:
                if run > 15 and not (high and abs(v) > 1) and not v and run == 16:
                    pending = flush(pending)
                    out.append((0xF0, kept))
                    run, kept = 0, ""
                elif v and not (high and abs(v) > 1):
                    pending = flush(pending)
                    if high:
                        out.append((run << 4 | 1, ("1" if v > 0 else "0") + kept))
                    else:
                        size = abs(v).bit_length()
                        out.append((run << 4 | size, f"{v if v > 0 else v + (1 << size) - 1:0{size}b}"))
                    run, kept = 0, ""
        if end < len(value) - 1:
            runs += 1
            pending += kept
            kept = ""
        if kept:
            raise AssertionError("bits left over")
        if runs == 0x7FFF:
            pending = flush(pending)
    flush(pending)
    return out


def plain_file(blocks, width, height, script):
    """A grey file with sparse coefficients, coded symbol by symbol."""
    head = b"\xff\xd8" + jpeg._marker(0xDB, b"\0" + bytes([3] * 64)) + jpeg._marker(0xC2, bytes([8, 0, height, 0, width, 1, 1, 0x11, 0]))
    body = b""
    for first, last, high, low in script:
        if first == 0:
            code, before = [], 0
            for b in blocks:
                v = int(b[0]) >> low
                if high:
                    code.append((None, str(v & 1)))
                else:
                    d, before = v - before, v
                    size = abs(d).bit_length()
                    code.append((size, f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else ""))
        else:
            code = scan_bits(blocks, first, last, high, low)
        symbols = sorted({s for s, _ in code if s is not None}) or [0]
        width_of = max(1, len(symbols).bit_length())
        word = {s: f"{i:0{width_of}b}" for i, s in enumerate(symbols)}
        bits = "".join((word[s] if s is not None else "") + x for s, x in code)
        bits += "1" * (-len(bits) % 8)
        data = int(bits or "1" * 8, 2).to_bytes(max(1, len(bits) // 8), "big")
        body += jpeg._marker(0xC4, jpeg._table(0x10 if first else 0, {width_of: symbols})) + jpeg._scan([(1, 0)], first, last, high, low) + data.replace(b"\xff", b"\xff\0")
    return head + body + b"\xff\xd9"


def test_decoder_on_sparse_files():
    rng = np.random.default_rng(9)
    files, want = [], []
    for trial in range(12):
        n = int(rng.integers(1, 9))
        blocks = np.where(rng.random((n, 64)) < (0.02, 0.2, 0.7)[trial % 3], rng.integers(-60, 61, (n, 64)), 0)
        script = [(0, 0, 0, 1), (1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (0, 0, 1, 0), (1, 63, 1, 0)]
        files.append(jpeg.parse(plain_file(blocks, 8 * n, 8, script)))
        want.append(blocks)
    got = jpeg.coefficients_of(files)
    assert np.array_equal(got, np.concatenate(want))
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    picture = jpeg.pictures(files, got)[0]
    first = np.clip(np.rint(basis @ (want[0][0].reshape(8, 8) * 3.0) @ basis.T + 128), 0, 255)
    assert np.abs(picture[:8, :8, 0] - first).max() <= 1


def test_broken_media():
    with pytest.raises(ValueError):
        jpeg.parse(b"no picture")


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path, limit = public_tokenizers.path("byte_bpe_50k.json"), 64
    whole = Tokenizer.from_file(path)
    got = packing.packed_documents(docs, path, limit).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    for i, t in distinct().items():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]})
        assert [p[1] for p in pieces] == [sum(p[2] for p in pieces[:k]) for k in range(len(pieces))] and sum(p[2] for p in pieces) == len(ids)
        assert all(p[2] == limit for p in pieces[1:]) and (len(pieces) == 1 or len(ids) > limit)
        assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for _, s, n, c in pieces)
    assert packing.packed_documents(empty, path).count() == 0


def test_plans_are_tight():
    rng = np.random.default_rng(0)
    for trial in range(6):
        counts = rng.integers(0, (3, 40, 100_000)[trial % 3], 257) * (rng.random(257) < 0.5)
        counts[0] = 0
        made = packing.plan(counts, 256)
        used = np.zeros(257, np.int64)
        for pattern, times in made:
            assert sum(pattern) <= 256
            used += times * np.bincount(pattern, minlength=257)
        assert np.array_equal(used, counts) and len(made) <= 3 * 256
        least = -(-int((counts * np.arange(257)).sum()) // 256)
        large = int(counts[129:].sum())
        assert sum(t for _, t in made) <= max(least, large) * 1.12 + 3


def test_shingles():
    assert [x.size for x in shingle_sets(["a b c d e", "A B c d E", "a b", None, "", "a b c d e a b c d e"], 4)] == [2, 2, 1, 0, 0, 5]
    one, two = shingle_sets(["a b c d e", "A\tB\nc  d E"], 4)
    assert np.array_equal(one, two)


def test_mix_takes_whole_documents(spark):
    rng = np.random.default_rng(9)
    made = [(None if i % 3 == 0 else i % 1200, " ".join(f"d{i}w{j}" for j in range(int(rng.integers(1, 120)))), f"s{i % 6}") for i in range(1500)]
    df = spark.createDataFrame([*made, made[1], (5, None, "s1")], "doc_id long, text string, source string")
    rows = Counter(map(tuple, df.collect()))
    got = Counter(map(tuple, mixing.mix_whole(df).collect()))
    assert set(got) <= set(rows) and all(n <= 2 * rows[r] for r, n in got.items())
    want = {r["source"]: r["target"] for r in mixing.mix(df).collect()}
    for source, target in want.items():
        assert abs(sum(len(r[1].split()) * n for r, n in got.items() if r[2] == source) - target) <= 120
    assert mixing.mix_whole(df.where("false")).count() == 0
    assert sorted(map(str, mixing.mix_whole(df.repartition(7)).collect())) == sorted(str(r) for r in mixing.mix_whole(df).collect())


def test_every_repeated_run_of_lines_goes(spark):
    rng = np.random.default_rng(10)
    pool = [" ".join(f"p{i}x{k}" for k in range(int(rng.integers(1, 12)))) for i in range(14)]
    made = ["\n".join(pool[int(k)] for k in rng.integers(0, len(pool), int(rng.integers(1, 9)))) for _ in range(60)]
    made[3] = "a licence line of more than eight words in one line"
    made[4] = f"other start\n{made[3]}\nother end"
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)).collect()}
    earlier = set()
    for i, text in enumerate(made):
        own, gone = text.split("\n"), set()
        for begin in range(len(own)):
            for end in range(begin + 1, len(own) + 1):
                run = tuple(own[begin:end])
                if sum(len(x.split()) for x in run) >= lines.LEAST_WORDS:
                    if run in earlier:
                        gone |= set(range(begin, end))
                    earlier.add(run)
        assert got[i]["n_removed"] == len(gone) and got[i]["text"] == "\n".join(x for k, x in enumerate(own) if k not in gone)
    assert got[4]["text"] == "other start\nother end"


def test_lines_around_a_shorter_first_occurrence(spark):
    made, want = [], []
    for i in range(60):
        inner = f"b{i} one two\nc{i} one two\nd{i} one"  # eight words; two of its lines alone are too short to go
        whole = f"a{i} long line at the edge of the run\n{inner}\ne{i} is another long line at the edge here"
        made += [f"own beginning {i}\n{inner}\nown end {i}", whole, whole, f"start {i}\nc{i} one two\nd{i} one\n{whole}"]
        want += [made[-4], f"{whole.split(chr(10))[0]}\n{whole.split(chr(10))[-1]}", "", f"start {i}\nc{i} one two\nd{i} one"]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)).collect()}
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_on_held_out_labels(spark, sf):
    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("needs the driver's tables")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = toxicity.scored(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").where("held_out")
    hits, given, toxic = held.selectExpr("count_if(predicted = 1 and toxic = 1)", "count_if(predicted = 1)", "count_if(toxic = 1)").first()
    assert hits >= 0.9 * toxic and hits >= 0.9 * given


def test_toxicity_learns_from_the_ends_of_long_texts(spark, monkeypatch):
    rng = np.random.default_rng(12)
    letters = list("abcdefghijklmnoprstuvw")
    clean = ["".join(rng.choice(letters, 6)) for _ in range(300)]
    rows = []
    for i in range(240):
        words = [str(w) for w in rng.choice(clean, 1200)]
        if i % 3 == 0:
            words[-40:-30] = ["zyzzyx", "qyxxaz"] * 5  # beyond 8000 characters
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int").drop("toxic"), spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(df, labels).collect()}
    held = [(got[a]["predicted"], c) for a, _, c in rows if got[a]["held_out"]]
    assert sum(p == c for p, c in held) >= 0.95 * len(held)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 50_000)
    given = []
    monkeypatch.setattr(toxicity, "train", lambda texts, marks: given.append((texts, marks)))
    toxicity.learn(df, labels, F.lit(True))
    texts, marks = given[0]
    assert set(texts) <= {x for _, x, _ in rows} and all(0 < sum(len(x) for x, y in zip(texts, marks, strict=True) if y == k) <= 50_000 for k in (0, 1))


def test_copies_of_one_line_can_be_left(spark):
    line, other = "a document of one line that has more than eight words", "another document of one line that has more than eight words"
    df = spark.createDataFrame(list(enumerate([line, line, f"top\n{line}", f"top\n{other}", other, other])), "doc_id long, text string")
    left = lambda copies: [r["text"] for r in lines.dedup_lines(df, copies=copies).orderBy("doc_id").collect()]
    assert left(True) == [line, "", "top", f"top\n{other}", "", ""]
    assert left(False) == [line, line, "top", f"top\n{other}", "", ""]
