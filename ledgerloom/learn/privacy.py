"""Pseudonyms for rows that leave the cluster: allowed columns only, consistent fakes, scrubbed text, shifted dates.

Everything is derived from a secret that is drawn for each run and is in no output: fakes are its digests with the
identifier, consistent inside a run and, without the secret, not to be recomputed from a list of names. (Plans hold the
secret as a literal, so event logs are as private as the data.) They are injective but for collisions of 96 bits. The
map from real to fake is a DataFrame of one run and is never written (first words of identifiers are, without fakes).
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..keeping import kept

MOST_DAYS = 3650
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
#: Words, and what stands between them.
WORDS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
#: Identifiers found in texts up to which their table is sent to every executor.
BROADCAST_ROWS = 50_000
#: First words of the identifiers of a length up to which texts are looked through for these words.
FIRST_WORDS = 1000


def digest(secret: str, purpose: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{secret}/{purpose}/"), value), 256)


def fake_of(kind: Column, real: Column, secret: str) -> Column:
    """96 bits of a digest, in letters only (so that the digit scrub leaves it alone); null without an identifier."""
    code = digest(secret, "fake", F.concat(kind, F.lit("/"), real))
    return F.when(F.trim(real) != "", F.concat(F.upper(F.left(kind, F.lit(1))), F.translate(F.left(code, F.lit(24)), "0123456789", "ghijklmnop")))


def fake_map(df: DataFrame, columns: dict[str, str], secret: str) -> DataFrame:
    """kind, real, fake: for the values of ``columns`` (column to kind); no task sees all identifiers."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(f"`{c}`").cast("string").alias("real")).where("trim(real) <> ''") for c, kind in columns.items()]
    if not parts:
        return df.sparkSession.createDataFrame([], "kind string, real string, fake string")
    return reduce(DataFrame.unionByName, parts).distinct().withColumn("fake", fake_of(F.col("kind"), F.col("real"), secret))


def shift_days(row: Column, secret: str) -> Column:
    """Days to shift a row's dates by: -MOST_DAYS to MOST_DAYS, never 0."""
    x = (F.conv(F.left(digest(secret, "days", row.cast("string")), F.lit(8)), 16, 10).cast("long") % (2 * MOST_DAYS)).cast("int")
    return F.when(x < MOST_DAYS, x - MOST_DAYS).otherwise(x - MOST_DAYS + 1)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once, however often ``f`` names it and also inside lambdas."""
    return F.transform(F.array(value), f)[0]


def other_digits(run: Column, secret: str) -> Column:
    """Other digits for a run, the same wherever the run stands."""
    long = F.repeat(digest(secret, "digits", run), F.ceil(F.length(run) / 64).cast("int"))
    return once(F.translate(F.left(long, F.length(run)), "abcdef", "012345"), lambda fake: F.when(fake != run, fake).otherwise(F.translate(run, "0123456789", "1234567890")))


def scrub_digits(df: DataFrame, column: str, secret: str) -> DataFrame:
    """Runs of five digits and more drawn anew."""
    parts = F.regexp_extract_all(column, F.lit(r"\d+|\D+"), F.lit(0))
    return df.withColumn(column, F.array_join(F.transform(parts, lambda x: F.when((F.length(x) >= 5) & x.rlike(r"^\d"), other_digits(x, secret)).otherwise(x)), ""))


def scrub_known(df: DataFrame, column: str, fakes: DataFrame, row: str) -> DataFrame:
    """What in ``column`` is an identifier of any row, replaced by its fake, whatever the case; where several fit, the
    first and longest. Runs of as many words as some identifier has are looked up by an equi-join; a pattern of all
    identifiers is never built. Where the identifiers of a length begin with few words, only runs that begin so are looked
    up. Else all are, and those that occur are made distinct before they meet the identifiers, so a common word is one row
    there, and only identifiers that occur go on."""
    parts = F.regexp_extract_all(column, F.lit(WORDS), F.lit(0))
    known = fakes.select(F.lower("real").alias("_key"), "fake").groupBy("_key").agg(F.min("fake").alias("fake"))
    words = F.regexp_extract_all("_key", F.lit(WORDS), F.lit(0))
    starts = kept(known.select(F.size(words).alias("n"), words[0].alias("first")).groupBy("n", "first").agg(F.count("*").alias("keys")))  # without fakes
    lengths = {r["n"]: r for r in starts.groupBy("n").agg(F.count("*").alias("firsts"), F.sum("keys").alias("keys")).collect()}
    if not lengths:
        return df
    few = [n for n, r in lengths.items() if r["firsts"] <= FIRST_WORDS]
    firsts: dict[int, list[str]] = {n: [] for n in few}
    for r in starts.where(F.col("n").isin(few)).collect():
        firsts[r["n"]].append(r["first"])

    def runs(parts: Column, n: int) -> Column:
        at = F.when(F.size(parts) >= n, F.sequence(F.lit(0), F.size(parts) - n)).otherwise(F.array().cast("array<int>"))
        if n in few:  # beyond ASCII lower case depends on what follows, so such words are looked up
            at = F.filter(at, lambda i: F.lower(parts[i]).isin(firsts[n]) | (F.octet_length(parts[i]) > F.length(parts[i])))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.lower(F.array_join(F.slice(parts, i + 1, n), "")).alias("key")))

    own = once(parts, lambda p: F.concat(*(runs(p, n) for n in lengths)))
    each = df.where(F.col(column).isNotNull()).select(row, F.explode(own).alias("_run")).select(row, F.col("_run.at").alias("_at"), F.col("_run.n").alias("_n"), F.col("_run.key").alias("_key"))
    if len(few) == len(lengths):
        present, small = known, sum(r["keys"] for r in lengths.values()) <= BROADCAST_ROWS
    else:
        present = known.join(each.select("_key").distinct(), "_key")
        small = present.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = each.join(F.broadcast(present) if small else present, "_key").groupBy(row).agg(F.sort_array(F.collect_list(F.struct("_at", F.negative("_n").alias("_less"), "fake"))).alias("_found"))
    begin = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<from:int,at:int,fake:string>>").alias("kept"))
    step = lambda acc, x: F.when(x["_at"] >= acc["free"], F.struct((x["_at"] - x["_less"]).alias("free"), F.concat(acc["kept"], F.array(F.struct(acc["free"].alias("from"), x["_at"].alias("at"), x["fake"].alias("fake")))).alias("kept"))).otherwise(acc)

    def shown(parts: Column) -> Column:
        between = lambda start, n: F.array_join(F.slice(parts, start + 1, n), "")
        pieces = F.transform("_taken.kept", lambda x: F.concat(between(x["from"], x["at"] - x["from"]), x["fake"]))
        return F.concat(F.array_join(pieces, ""), between(F.col("_taken.free"), F.size(parts)))

    done = df.join(found.select(row, F.aggregate("_found", begin, step).alias("_taken")), row, "left")
    return done.withColumn(column, F.when(F.col("_taken").isNull(), F.col(column)).otherwise(once(parts, shown))).drop("_taken")


def pseudonymise(df: DataFrame, row: str, identifiers: dict[str, str], allowed: list[str], dates: list[str], target: str | None = None, secret: str | None = None, everyone: DataFrame | None = None) -> DataFrame:
    """Only ``row``, identifiers (as fakes) and ``allowed`` columns. ``dates`` among them, and the ``target`` where it is a
    date, shifted by the row's days; in any other target known identifiers and long digit runs replaced. The identifiers
    looked for are those of all rows of ``everyone``, of which ``df`` may be a part. Without a ``secret`` one is drawn."""
    secret = secret or secrets.token_hex(16)
    fakes = fake_map(df if everyone is None else everyone, identifiers, secret)
    days = shift_days(F.col(row), secret)
    out = df.select(row, *(f"`{c}`" for c in [*identifiers, *allowed]), *([target] if target else []))
    out = out.withColumns({c: fake_of(F.lit(kind), F.col(f"`{c}`").cast("string"), secret) for c, kind in identifiers.items()})
    out = out.withColumns({c: F.date_add(F.col(f"`{c}`").cast("date"), days) for c in dates if c in allowed})
    if target:
        text = F.col(target).cast("string")
        moved = F.date_format(F.date_add(F.when(text.rlike(ISO_DATE), text).try_cast("date"), days), "yyyy-MM-dd")
        out = out.withColumns({"_moved": moved, target: F.when(moved.isNull(), text)})  # a date never meets the text scrub
        out = scrub_digits(scrub_known(out, target, fakes, row), target, secret)
        out = out.withColumn(target, F.coalesce("_moved", target)).drop("_moved")
    return out
