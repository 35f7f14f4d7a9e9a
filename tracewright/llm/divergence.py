"""Divergence of sources by shards of (lang, term) that DuckDB counts.

Tasks take texts apart and sum each (lang, source, term) for themselves; the sums are dealt to shards by lang and term. A
shard's sums stream into an in-memory DuckDB table that is grouped again whenever it has grown, and SQL keeps the terms
found in enough documents of their lang. Spark sums the kept counts by source and by lang, and deals the kept terms to
shards again, now with their groups' totals. There DuckDB computes with exact integers, in SQL:

    terms   f of every kept term a source uses more than its lang does, and of these each group's first ones
    pairs   for two sources of a lang, what the terms that both use add to the sum beyond what they would add if neither did
    uses    for a source, how many terms have each p

Spark adds the pairs of all shards, and what one side alone uses comes from `uses`: f depends on p only, so terms of one p
count together. Terms that neither side uses add the same f each. So no row stands for a term that a source lacks.

Defined cases: null lang, source and text are ''; a group without terms has all counts 0; a lang without kept terms gives
pairs of value 0; rows are documents (repeated rows and rows that share a doc_id count again); a very long text is taken
apart alone; ties fall by UTF-8 bytes of the item; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, slices

LEAST = 10
FIRST = 10
SCALE = 1_000_000_000
BLOCK = 4 << 20
#: Sums that a task remembers before it passes them on; rows of a shard, as a mean; rows between two groupings of a shard.
MANY = 500_000
SHARD = 1 << 19
GROWN = 1 << 20
#: ASCII other than letters is a blank; A-Z lower-cased.
TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def term_sums(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), summed within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        groups: dict[tuple[str, str], int] = {}
        sums = [np.zeros(0, np.int64) for _ in range(3)]  # group and term in one number, n, d

        def flush() -> Iterator[pa.RecordBatch]:
            names, terms = list(groups), pa.array([t.decode() for t in known], pa.string())
            langs, sources = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
            for i in range(0, len(sums[0]), 100_000):
                key, n, d = (s[i : i + 100_000] for s in sums)
                group = pa.array(key >> 32)
                yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), terms.take(pa.array(key & 0xFFFFFFFF)), pa.array(n), pa.array(d)], ["lang", "source", "term", "n", "d"])

        for batch in batches:
            for b in slices([batch], "text", BLOCK):
                ids, owner, of = [], [], []
                for row, (lang, source, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True)):
                    words = text.encode().translate(TABLE).split()
                    of.append(groups.setdefault((lang, source), len(groups)))
                    ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
                    owner.append(np.full(len(words), row, np.int64))
                # each document's terms, then the terms of each group
                held, n = np.unique(np.concatenate(owner) << 32 | np.concatenate(ids), return_counts=True)
                key = np.array(of, np.int64)[held >> 32] << 32 | held & 0xFFFFFFFF
                key = np.concatenate([sums[0], key])
                both = (np.concatenate([sums[1], n]), np.concatenate([sums[2], np.ones(len(n), np.int64)]))
                found, at = np.unique(key, return_inverse=True)
                sums = [found, *(np.bincount(at, x, len(found)).astype(np.int64) for x in both)]
                if len(found) > MANY:
                    yield from flush()
                    known, groups, sums = {}, {}, [np.zeros(0, np.int64) for _ in range(3)]
        yield from flush()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, d long")


def _database() -> duckdb.DuckDBPyConnection:
    """In memory alone: nothing is spilled to a folder of the machine."""
    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "memory_limit": "1GB"})


def kept_terms(sums: DataFrame, shards: int, least: int = LEAST) -> DataFrame:
    """lang, source, term, n, total (the term's occurrences in its lang), head (true in one row of each lang and term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, new = _database(), 0
        con.execute("create table sums (lang varchar, source varchar, term varchar, n bigint, d bigint)")
        for b in batches:
            con.register("batch", pa.Table.from_batches([b]))
            con.execute("insert into sums select lang, source, term, n, d from batch")
            new += b.num_rows
            if new > GROWN:
                con.execute("create or replace table sums as select lang, source, term, sum(n)::bigint as n, sum(d)::bigint as d from sums group by all")
                new = 0
        found = con.sql(
            """
            with counts as (select lang, source, term, sum(n)::bigint as n, sum(d)::bigint as d from sums group by all)
            select lang, source, term, n, (sum(n) over same)::bigint as total, row_number() over (partition by lang, term order by source) = 1 as head
            from counts window same as (partition by lang, term) qualify sum(d) over same >= ?
            """,
            params=[least],
        )
        yield from _arrow(found)

    return sums.repartition(shards, "lang", "term").mapInArrow(run, "lang string, source string, term string, n long, total long, head boolean")


def _arrow(found: duckdb.DuckDBPyRelation) -> Iterator[pa.RecordBatch]:
    yield from found.to_arrow_table().to_batches(max_chunksize=100_000)


#: p of a count among the counts of a group of which the SQL has the sum and the number of kept terms; f of two of them.
MACROS = f"""
create macro share(n, whole, terms) as (1 + ({SCALE}::hugeint * (n + 2)) // (whole + 2::hugeint * terms))::bigint;
create macro apart(p, q) as ((p - q) * (p - q)) // (p + q);
"""


def shard_sums(kept: DataFrame, shards: int, first: int = FIRST) -> DataFrame:
    """Partial results of each shard of kept terms with their totals (whole and lang_whole: the counts' sums, terms: kept ones):
    kind `term` (item, value, up to `first` a group), `pair` (item: another source, value) and `use` (p, value: terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _database()
        con.execute(MACROS + "create table uses (lang varchar, source varchar, term varchar, p bigint, p0 bigint, q bigint)")
        for b in batches:
            con.register("batch", pa.Table.from_batches([b]))
            con.execute("insert into uses select lang, source, term, share(n, whole, terms), share(0, whole, terms), share(total, lang_whole, terms) from batch")
        yield from _arrow(con.sql(
            """
            select 'term' as kind, lang, source, term as item, null::bigint as p, apart(p, q) as value from uses
            where p > q qualify row_number() over (partition by lang, source order by value desc, term) <= ?
            """,
            params=[first],
        ))
        yield from _arrow(con.sql("select 'use' as kind, lang, source, null::varchar as item, p, count(*)::bigint as value from uses group by all"))
        yield from _arrow(con.sql(
            """
            select 'pair' as kind, a.lang, a.source, b.source as item, null::bigint as p,
                sum(apart(a.p, b.p) - apart(a.p, b.p0) - apart(a.p0, b.p) + apart(a.p0, b.p0))::bigint as value
            from uses a join uses b on a.lang = b.lang and a.term = b.term and a.source < b.source group by all
            """
        ))

    return kept.repartition(shards, "lang", "term").mapInArrow(run, "kind string, lang string, source string, item string, p long, value long")


def _share(n: str, whole: str, terms: str) -> str:
    return f"cast(1 + (cast({SCALE} as decimal(10, 0)) * ({n} + 2)) div (cast({whole} as decimal(20, 0)) + 2 * {terms}) as bigint)"


def audit(docs: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from each other one of its lang, and by which terms."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    sums = materialize(term_sums(rows), "term-sums")
    n = max(partitions(docs.sparkSession), -(-sums.count() // SHARD))
    kept = materialize(kept_terms(sums, n, least), "kept-terms")
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("head").cast("long")).alias("heads"))
    groups = rows.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").fillna(0, ["n", "heads"])
    by_lang = by_source.groupBy("lang").agg(F.sum("n").alias("lang_whole"), F.sum("heads").alias("terms"))
    groups = groups.withColumnRenamed("n", "whole").drop("heads").join(by_lang, "lang", "left").fillna(0, ["lang_whole", "terms"])
    groups = materialize(groups.withColumn("p0", F.expr(f"case when terms > 0 then {_share('0L', 'whole', 'terms')} end")), "groups")
    parts = materialize(shard_sums(kept.join(groups, ["lang", "source"]).drop("head", "p0"), n, first), "shard-sums")
    apart = lambda p, q: f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"
    # what a source's own terms add beyond the other's p0, by p; then all terms at p0; then what both use, from either end
    uses = parts.where("kind = 'use'").groupBy("lang", "source", "p").agg(F.sum("value").alias("terms"))
    one = groups.select("lang", "source", "p0", "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    two = other.where("q0 is not null")
    alone = uses.join(one.drop("terms"), ["lang", "source"]).join(two, "lang").where("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.expr(f"terms * ({apart('p', 'q0')} - {apart('p0', 'q0')})")).alias("value"))
    none = one.join(other, "lang").where("source <> item").selectExpr("lang", "source", "item", f"coalesce(terms * {apart('p0', 'q0')}, 0L) as value")
    both = parts.where("kind = 'pair'").select("lang", "source", "item", "value")
    turn = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = none.union(alone).union(turn(alone)).union(both).union(turn(both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = parts.where("kind = 'term'").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))).cast("int")
    best = terms.withColumn("rank", place).where(F.col("rank") <= first)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", place).unionByName(best)
