"""DuckDB SQL for the rows of op11, op12 and op13."""

from __future__ import annotations

import re

from . import dialogue, merkle, secretscan

CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS crc_table)"


def crc32(text: str) -> str:
    """Of an ASCII text, with CRC_TABLE at hand."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"


def _either_case(pattern: str) -> str:
    """The pattern with (?i:...) spelled out in ASCII letters."""
    inside = re.search(r"\(\?i:((?:[^()]|\([^()]*\))*)\)", pattern)
    if not inside:
        return pattern
    spelled = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", inside[1])
    return pattern[: inside.start()] + f"(?:{spelled})" + pattern[inside.end() :]


def _hits(number: int, rule: secretscan.Rule) -> str:
    p = "'" + _either_case(rule.pattern).replace("'", "''") + "'"
    return f"SELECT rid, {number} AS k, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(t, {p}) AS h, regexp_extract_all(t, {p}, {rule.group}) AS g, string_split_regex(t, {p}) AS b FROM d"


def secrets_sql(base: tuple[secretscan.Rule, ...] = secretscan.BASE, more: tuple[secretscan.Rule, ...] = secretscan.MORE) -> str:
    kinds = ", ".join(f"'{r.kind}'" for r in base)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in base)
    filled = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in base)
    span = "kind || ':' || start || ':' || (start + length(hit))"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
 hits AS ({" UNION ALL ".join(_hits(i, r) for i, r in enumerate(base + more))}),
 matched AS (SELECT rid, k, kind, least, unnest(list_transform(range(1, len(h) + 1), lambda i: {{'start': list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0), 'hit': h[i], 'checked': g[i]}}), recursive := true) FROM hits WHERE len(h) > 0),
 listed AS (SELECT rid, {counts}, string_agg({span}, ',' ORDER BY start, k) FILTER (kind IN ({kinds})) AS own, string_agg({span}, ',' ORDER BY start, k) AS spans FROM matched WHERE length(checked) >= least GROUP BY rid)
 SELECT doc_id, {filled}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (rid)"""


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _edited(state: str, cost: str, letter: str, line: str | None) -> str:
    added = f"list_append({state}.o, {line})" if line else f"{state}.o"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {added}}}"


def _inserted(pairs: list[str]) -> list[str]:
    """The four states (nothing yet, s, u, a) with rows inserted."""
    nothing, s, u, a = pairs
    user = _least(u, *(_edited(x, str(dialogue.INSERT), "I", "'user:'") for x in (nothing, s, a)))
    return [nothing, s, user, a]


FAR = "{'c': 1000000000::BIGINT, 'a': '', 'o': []::VARCHAR[]}"


def dialogue_sql() -> str:
    started = ["{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}", FAR, FAR, FAR]
    may, more = "(NOT gone)", f"(CASE WHEN cut THEN {dialogue.CUT} ELSE 0 END)"
    kept = lambda x, initial: f"CASE WHEN {may} AND initial = '{initial}' THEN {_edited(x, more, 'K', "role || ':' || text")} ELSE {FAR} END"
    given = lambda x, role: f"CASE WHEN {may} THEN {_edited(x, f'{more} + {dialogue.REROLE}', 'R', f"'{role}:' || text")} ELSE {FAR} END"
    left = lambda x: _edited(x, str(dialogue.DELETE), "D", None)
    moved = [
        left("s0"), _least(left("s1"), kept("s0", "s")),
        _least(left("s2"), *(w for x in ("s0", "s1", "s3") for w in (kept(x, "u"), given(x, "user")))), _least(left("s3"), kept("s2", "a"), given("s2", "assistant")),
    ]
    close = lambda four: "SELECT conv, pos, s0, s1, s2, " + _least("s3", _edited("s2", str(dialogue.INSERT), "I", "'assistant:'")) + " AS s3 FROM (SELECT conv, pos, s0, s1, " + _inserted(["s0", "s1", "s2", "s3"])[2] + f" AS s2, s3 FROM ({four}))"
    first = "SELECT DISTINCT conv, 0::BIGINT AS pos, " + ", ".join(f"{x} AS s{i}" for i, x in enumerate(started)) + " FROM named"
    after = "SELECT p.conv, p.pos + 1 AS pos, " + ", ".join(f"{x} AS s{i}" for i, x in enumerate(moved)) + " FROM parsed p JOIN marked m ON m.conv = p.conv AND m.pos = p.pos + 1"
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE named AS MATERIALIZED (SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, {CRC_TABLE}),
 edited AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM named WHERE kind <> 0),
 placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos, rtrim(text, {blank}) AS body, role[1] AS initial FROM edited),
 seen AS (SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS again, right(body, 1) NOT IN ('.', '!', '?') AS cut, lag(initial) OVER (PARTITION BY conv ORDER BY pos) || initial AS pair FROM placed),
 marked AS MATERIALIZED (SELECT *, blank OR again AS gone FROM seen),
 parsed AS ({close(first)} UNION ALL {close(after)}),
 counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT gone) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM marked GROUP BY conv),
 ended AS (SELECT p.conv, {_least("s0", "s3")} AS best FROM parsed p LEFT JOIN counts c ON c.conv = p.conv WHERE p.pos = coalesce(c.n, 0))
 SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(array_to_string(best.o, chr(10))) AS repaired_sha256 FROM (SELECT DISTINCT conv, conv_id FROM named) JOIN ended USING (conv) LEFT JOIN counts USING (conv)"""


def _tree(name: str, leaves: str, levels: int) -> list[str]:
    """CTEs name0, name1, ...: the levels; name{k}r: their runs."""
    out = [f"{name}0 AS MATERIALIZED ({leaves})"]
    for k in range(levels):
        out.append(f"{name}{k}r AS MATERIALIZED (SELECT grp, spot // {merkle.ARITY} AS spot, any_value(n) AS n, list(node ORDER BY spot) AS nodes FROM {name}{k} GROUP BY grp, spot // {merkle.ARITY})")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT grp, spot, CASE WHEN n > 1 THEN (n + {merkle.ARITY - 1}) // {merkle.ARITY} ELSE 1 END AS n, CASE WHEN n > 1 THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS node FROM {name}{k}r)")
    return out


def merkle_sql(levels: int = 8, over: int = 4) -> str:
    """For groups of up to 8 ** levels rows and 8 ** over languages."""
    written = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(written(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    steps = [f"t{k}r" for k in range(levels)] + [f"o{k}r" for k in range(over)]
    place = [f"l.spot // {merkle.ARITY**k}" for k in range(levels)] + [f"g.spot // {merkle.ARITY**k}" for k in range(over)]
    joins = " ".join(f"JOIN {r} ON {r}.grp = {'l.grp' if r[0] == 't' else '0'} AND {r}.spot = ({p}) // {merkle.ARITY}" for r, p in zip(steps, place))
    sides = [(f"array_to_string({r}.nodes[1:({p}) % {merkle.ARITY}], '')", f"array_to_string({r}.nodes[({p}) % {merkle.ARITY} + 2:], '')", f"{r}.n") for r, p in zip(steps, place)]
    pairs = "[" + ", ".join(f"{{'l': {a}, 'r': {b}, 'n': {n}}}" for a, b, n in sides) + "]"
    ctes = [
        f"leaves AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc32("coalesce(doc_id, 0)::VARCHAR")} % 3 = 0 THEN {leaf(f"translate(text, '{upper}', '{lower}')")} ELSE {leaf('text')} END AS given FROM documents, {CRC_TABLE})",
        "langs AS MATERIALIZED (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp FROM (SELECT DISTINCT lang FROM leaves))",
        "ranked AS MATERIALIZED (SELECT doc_id, leaf, given, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY grp) AS n FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang)",
        *_tree("t", "SELECT grp, spot, n, leaf AS node FROM ranked", levels),
        *_tree("o", f"SELECT 0 AS grp, grp AS spot, count(*) OVER () AS n, node FROM t{levels}", over),
        f"proofs AS (SELECT l.doc_id, l.leaf, l.given, g.node AS subroot, o{over}.node AS root, {pairs} AS proof FROM ranked l JOIN o0 g ON g.spot = l.grp JOIN o{over} ON o{over}.spot = 0 {joins})",
        "folded AS (SELECT *, list_reduce(list_prepend({'l': given, 'r': '', 'n': 0::BIGINT}, proof), lambda x, p: CASE WHEN p.n > 1 THEN {'l': sha256(p.l || x.l || p.r), 'r': '', 'n': 0::BIGINT} ELSE x END).l AS folded_root FROM proofs)",
    ]
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda p: p.l || p.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"
