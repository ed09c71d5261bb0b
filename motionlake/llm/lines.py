"""Line deduplication by winnowed line hashes.

The lines of a document that hold a word form a sequence; blank lines take no part and
stay. A run of consecutive lines is deleted where it occurs again if it has ``RUN`` lines or
more, or ``WORDS`` words or more: long passages go whatever their line breaks, and short
lines that agree by chance stay. Windows of 1 to ``RUN`` lines that meet this rule are
compared (longer runs are unions of them). From every window the smallest line hash (the last
one on ties) is its fingerprint, so equal windows always share one. Only windows whose
fingerprint occurs at two places or more go on: these positions are joined, and each match
is extended both ways over all windows around the fingerprint by comparing window digests.
A window is repeated when the same lines start at an earlier place (smaller doc_id, or
earlier in the same document); all lines inside repeated windows are deleted, which is the
union of the maximal repeated runs.

Common lines never gather in one task: fingerprints and digests are counted with partial
aggregation, and the two joins have one row per key on their other side, so adaptive skew
splitting applies.

Edge cases: null text stays null; rows with the same id and text get the same result and
never delete each other's lines; a null id counts as the largest id; a text that loses all
its lines becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import GAP, document_key, let
from motionlake.session import settle

RUN = 3
WORDS = 25
SPACES = "".join(chr(c) for c in (0x20, *range(0x09, 0x0E)))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _units(lines: Column) -> Column:
    """Lines with a word: their place, prefixed text and hash."""
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("i"), _bare(x).alias("x")))
    return F.filter(marked, lambda u: u["x"] != "")


def windows(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """Every window that may go: document key, text digest, start, size, fingerprint and digest."""
    units = docs.select(
        document_key(F.col("doc_id")).alias("key"),
        F.xxhash64("text").alias("version"),
        F.transform(
            _units(_lines(F.col("text"))), lambda u: F.struct(u["x"].alias("x"), F.xxhash64(u["x"]).alias("h"), F.size(F.split(u["x"], GAP)).alias("n"))
        ).alias("u"),
    ).where(F.size("u") > 0)

    def at(u: Column, s: Column, size: int) -> Column:
        span = F.slice(u, s + 1, size)
        places = F.array(*[F.struct(F.get(u, s + k)["h"].alias("h"), F.lit(-k).alias("k")) for k in range(size)])
        return F.struct(
            s.alias("start"),
            F.lit(size).alias("size"),
            F.array_min(places).alias("seed"),
            F.unhex(F.md5(F.concat_ws("\n", F.transform(span, lambda v: v["x"])))).alias("digest"),
        )

    def long_enough(u: Column, s: Column, size: int) -> Column:
        return F.lit(True) if size == run else sum((F.get(u, s + k)["n"] for k in range(1, size)), F.get(u, s)["n"]) >= words

    def of_size(u: Column, size: int) -> Column:
        starts = F.when(F.size(u) >= size, F.sequence(F.lit(0), F.size(u) - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(starts, lambda s: long_enough(u, s, size)), lambda s: at(u, s, size))

    found = let(F.col("u"), lambda u: F.concat(*[of_size(u, size) for size in range(1, run + 1)]))
    return units.select("key", "version", F.explode(found).alias("w")).select(
        "key",
        "version",
        "w.start",
        "w.size",
        F.col("w.seed.h").alias("seed"),
        (F.col("w.start") - F.col("w.seed.k")).alias("place"),
        "w.digest",
    )


def repeated_starts(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """Per document with repeats: sorted ``starts`` (place and size) of the windows seen earlier."""
    every = settle(windows(docs, run, words))
    # A fingerprint at one place only cannot belong to a repeated window.
    ends = F.struct("key", "version", "place")
    seeds = every.groupBy("seed").agg(F.min(ends).alias("a"), F.max(ends).alias("b")).where("a <> b").select("seed")
    matched = every.join(seeds, "seed", "left_semi")
    first = every.join(seeds, "seed", "left_semi").groupBy("digest").agg(
        F.min(F.struct("key", "start")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    later = matched.join(first.where("n > 1").drop("n"), "digest").where(
        (F.col("key") > F.col("first.key")) | (F.col("key") == F.col("first.key")) & (F.col("start") > F.col("first.start"))
    )
    return later.groupBy("key", "version").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("starts"))


def dedup_lines(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """``r`` (the whole input row), its ``kept`` text, ``n_lines`` and ``n_removed``."""
    starts = repeated_starts(docs, run, words).select(
        F.col("key").alias("_key"), F.col("version").alias("_version"), "starts"
    )
    carried = docs.select(F.struct("*").alias("r")).withColumns(
        {"_key2": document_key(F.col("r.doc_id")), "_version2": F.xxhash64("r.text")}
    )
    joined = carried.join(
        starts, (F.col("_key2") == F.col("_key")) & (F.col("_version2") == F.col("_version")), "left"
    )
    # Lines carry their place as a prefix, which makes them distinct strings, so that
    # array_except (hash based for strings) deletes exactly the repeated ones.
    tag = lambda i, x: F.concat(F.lpad(i.cast("string"), 10, "0"), x)

    def cut(lines: Column) -> Column:
        places = let(
            F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda u: _bare(u["x"]) != ""),
            lambda u: F.flatten(
                F.transform(F.col("starts"), lambda s: F.transform(F.slice(u, s["start"] + 1, s["size"]), lambda v: tag(v["i"], v["x"])))
            ),
        )
        left = F.array_except(F.transform(lines, lambda x, i: tag(i, x)), places)
        return F.transform(left, lambda x: F.substr(x, F.lit(11)))

    lines = _lines(F.col("r.text"))
    kept_lines = let(lines, cut)
    alive = F.exists("kept_lines", lambda x: _bare(x) != "")
    text = F.when(alive, F.array_join("kept_lines", "\n")).otherwise(F.lit(""))
    hit = F.col("starts").isNotNull()
    return (
        joined.withColumn("kept_lines", F.when(hit, kept_lines))
        .withColumn("kept", F.when(hit, text).otherwise(F.col("r.text")))
        .withColumn("n_lines", F.when(F.col("r.text").isNull(), 0).otherwise(F.size(lines)).cast("bigint"))
        .withColumn(
            "n_removed", F.when(hit, F.col("n_lines") - F.size("kept_lines")).otherwise(F.lit(0)).cast("bigint")
        )
        .select("r", "kept", "n_lines", "n_removed")
    )


def deduplicated_documents(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """The documents with repeated lines cut out of ``text``; ``n_chars`` follows, if there."""
    out = dedup_lines(docs, run, words)
    text = F.col("kept")
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(text.alias("text"))
        elif name == "n_chars":
            kind = docs.schema["n_chars"].dataType
            columns.append(F.when(F.col("n_removed") > 0, F.char_length(text)).otherwise(F.col("r.n_chars")).cast(kind).alias("n_chars"))
        else:
            columns.append(F.col("r").getField(name).alias(name))
    return out.select(*columns)


def line_report(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    return dedup_lines(docs, run, words).select(
        F.col("r.doc_id").alias("doc_id"),
        "n_lines",
        "n_removed",
        F.sha2(F.coalesce(F.col("kept"), F.lit("")), 256).alias("kept_sha256"),
    )


def oracle(docs: str = "documents", run: int = RUN, words: int = WORDS) -> str:
    spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    nexts = ", ".join(f"lead({c}, {k}) OVER o AS {c}{k}" for k in range(1, run) for c in "xn")
    found = []
    for size in range(1, run + 1):
        group = ", ".join(["x", *(f"x{k}" for k in range(1, size))])
        total = " + ".join(["n", *(f"n{k}" for k in range(1, size))])
        rule = f"x{run - 1} IS NOT NULL" if size == run else f"{total} >= {words}"
        found.append(f"SELECT r, p, {size} AS size, doc_id, min((doc_id, p)) OVER (PARTITION BY {group}) AS m FROM w WHERE {rule}")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text IS NULL AS gone, string_split(coalesce(text, ''), chr(10)) AS l FROM {docs}),
e AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
u AS (SELECT r, doc_id, i, trim(line, {spaces}) AS x, len(regexp_split_to_array(trim(line, {spaces}), '{GAP}')) AS n,
  row_number() OVER (PARTITION BY r ORDER BY i) AS p FROM e WHERE trim(line, {spaces}) <> ''),
w AS (SELECT r, doc_id, p, x, n, {nexts} FROM u WINDOW o AS (PARTITION BY r ORDER BY p)),
f AS ({" UNION ALL ".join(found)}),
c AS (SELECT DISTINCT r, p + k AS p FROM f, (SELECT unnest(range({run})) AS k) WHERE (doc_id, p) > m AND k < size),
k AS (SELECT e.r, count(*) FILTER (c.r IS NOT NULL) AS n, count(*) FILTER (c.r IS NULL AND u.r IS NOT NULL) AS alive,
  string_agg(line, chr(10) ORDER BY e.i) FILTER (c.r IS NULL) AS t FROM e LEFT JOIN u USING (r, i) LEFT JOIN c ON c.r = u.r AND c.p = u.p GROUP BY e.r)
SELECT doc_id, CASE WHEN gone THEN 0 ELSE len(l) END AS n_lines, n AS n_removed,
  sha256(CASE WHEN n > 0 AND alive = 0 THEN '' ELSE coalesce(t, '') END) AS kept_sha256 FROM d JOIN k USING (r)"""
