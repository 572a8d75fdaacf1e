"""Source divergence audit: how far the words of each source lie from those of its language.

Terms are counted where the texts are, per task, and summed by (language,
source, term). A language keeps the terms of enough of its documents. The kept
terms are put in UTF-8 order, numbered and cut into chunks of neighbours. A task gets one chunk: its sorted terms are the dictionary,
``searchsorted`` turns the terms of the counts into ids, ``bincount`` makes one
dense vector per source. Ids keep the order of the terms, so ties are broken by
position. Distances of pairs add up over chunks; the top terms of a source are
the best of each chunk's best.

A chunk has so many terms that its vectors over all sources stay within
``CELLS`` numbers, whatever the size of the vocabulary or the hot source.
Shares are exact integers: floor(10^9 (c + 5) / M) by long division, three
digits at a time, within 64 bits for counts up to 9 * 10^12.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.llm.common import numbered, sized, table, write_table

#: A language keeps terms of at least this many of its documents.
MIN_DOCS = 30
#: Added to every count.
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: Numbers in the dense vectors of a chunk.
CELLS = 1 << 20
#: Distinct (language, source, term) keys that a task holds before it hands them on.
HELD = 400_000
#: Byte map: letters of terms kept, A-Z to a-z, all that ends a term to a blank.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term) with ``docs`` that hold the term and ``n`` occurrences; nulls are ''."""
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])

    def count(batches):
        held: dict[tuple, dict[bytes, list[int]]] = {}
        size = 0

        def flush():
            for (lang, source), terms in held.items():
                keys = list(terms)
                for k in range(0, len(keys), 20_000):
                    part = keys[k : k + 20_000]
                    both = np.array([terms[t] for t in part], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                            pa.array([t.decode("utf-8", "replace") for t in part], pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1]),
                        ],
                        schema=schema,
                    )

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                terms = held.setdefault((lang, source), {})
                before = len(terms)
                for term, n in Counter(text.encode("utf-8", "replace").translate(TERM).split()).items():
                    both = terms.get(term)
                    if both is None:
                        terms[term] = [1, n]
                    else:
                        both[0] += 1
                        both[1] += n
                size += len(terms) - before
                if size > HELD:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    counted = texts.mapInArrow(count, "lang string, source string, term string, docs long, n long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def chunked(kept: DataFrame, groups: DataFrame, cells: int) -> DataFrame:
    """``kept`` (lang, term) with ``chunk``: neighbours in UTF-8 order, about ``cells`` / sources of the language in each.

    Terms are numbered within their language, and the chunks are equal spans
    of numbers: their borders do not depend on how the work is dealt to tasks.
    """
    width = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    widest = groups.agg(F.max(F.octet_length("lang"))).first()[0] or 0
    each = numbered(kept.select(F.col("lang").alias("g"), "term"), ["term"], "kept").withColumnRenamed("g", "lang")
    each = each.join(sized(width, 64 + widest), "lang")
    share = F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("sources")))
    return each.select("lang", "term", F.floor(F.col("idx") / share).alias("chunk"))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / total), exactly; ``total`` is of the same or a matching shape and at least count + 5."""
    rest = counts + SMOOTH
    out = rest // total  # 1 where a term is all there is, else 0
    rest = rest % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def compare(counts: pd.DataFrame, groups: pd.DataFrame, top: int) -> pd.DataFrame:
    """One chunk of a language: partial distances of all pairs of sources, and the best terms of each source.

    ``counts`` has source, term, n; ``groups`` one row per source of the
    language with ``total``, its M, and ``lang_total``.
    """
    lang = groups["lang"].iloc[0]
    names = sorted(groups["source"], key=lambda s: s.encode())
    total = groups.set_index("source")["total"].to_dict()
    m = np.array([total[s] for s in names], np.int64)[:, None]
    row_of = {s: k for k, s in enumerate(names)}
    found = np.array([t.encode() for t in counts["term"]], object)
    terms = np.array(sorted(set(found)), object)  # the dictionary, in UTF-8 order
    ids = np.searchsorted(terms, found) if len(found) else np.zeros(0, np.int64)
    rows = counts["source"].map(row_of).to_numpy(np.int64)
    shape = (len(names), len(terms))
    # one row per (source, term), so the doubles of bincount are whole numbers below 2^53
    dense = np.bincount(rows * shape[1] + ids, counts["n"].to_numpy(np.float64), shape[0] * shape[1]).astype(np.int64).reshape(shape)
    p = shares(dense, m) if len(terms) else dense
    out = []
    for k, name in enumerate(names[:-1]):
        far = np.abs(p[k + 1 :] - p[k]).sum(axis=1)
        out += [(name, "pair", names[k + 1 + j], int(v)) for j, v in enumerate(far)]
    if len(terms):
        ahead = p - shares(dense.sum(axis=0)[None, :], np.int64(groups["lang_total"].iloc[0]))
        for k, name in enumerate(names):
            mine = np.flatnonzero((dense[k] > 0) & (ahead[k] > 0))
            best = mine[np.lexsort((mine, -ahead[k][mine]))][:top]
            out += [(name, "term", terms[i].decode(), int(ahead[k][i])) for i in best]
    return pd.DataFrame([(lang, *r) for r in out], columns=["lang", "source", "part", "item", "value"])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: see :func:`op13_source_divergence`.

    Null text, language and source count as ''. A group without terms takes
    part with counts of 0; a language without kept terms has pairs of value 0
    and no terms. Repeated rows count as often as they occur; other columns
    are ignored; no rows, no result.
    """
    counted = write_table(term_counts(docs), "terms")
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    names = docs.select(*named).distinct()
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")
    kept = write_table(kept, "vocabulary")
    chunks = write_table(chunked(kept, names, cells), "chunks")
    counts = write_table(counted.drop("docs").join(chunks, ["lang", "term"]), "counts")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    words = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = names.join(sums, ["lang", "source"], "left").join(words, "lang", "left").na.fill(0, ["n", "v"])
    whole = F.sum("n").over(Window.partitionBy("lang"))
    groups = write_table(
        groups.select("lang", "source", (F.col("n") + SMOOTH * F.col("v")).alias("total"), (whole + SMOOTH * F.col("v")).alias("lang_total")), "groups"
    )
    each = chunks.select("lang", "chunk").distinct()
    each = groups.join(each, "lang", "left").na.fill(0, ["chunk"])  # a language without kept terms has one empty chunk
    keys = ["lang", "chunk"]

    def run(left, right):
        return compare(left, right, top)

    shape = "lang string, source string, part string, item string, value long"
    both = counts.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInPandas(run, shape)
    both = write_table(both, "compared")
    pairs = both.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item")))
    return pairs.unionByName(both.where("part = 'term'")).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source of a language: its distance to each other one, and the 50 terms it has most in excess of the language."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), w as (
  select id, lang, source, unnest(terms) as term from d
), c as (
  select lang, source, term, count(*) as n, count(distinct id) as docs from w group by all
), kept as (
  select lang, term, sum(n)::bigint as n from c group by all having sum(docs) >= 30
), k as (
  select lang, count(*) as v, sum(n)::bigint as n from kept group by all
), g as (
  select distinct lang, source from d
), s as (
  select g.lang, g.source, coalesce(sum(c.n), 0)::bigint as n
  from g left join (select c.* from c join kept using (lang, term)) c on c.lang = g.lang and c.source = g.source group by all
), p as (
  select s.lang, s.source, kept.term, coalesce(c.n, 0) as c,
    (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (s.n + 5 * k.v))::bigint as p,
    (1 + (1000000000::hugeint * (kept.n + 5)) // (k.n + 5 * k.v))::bigint as q
  from s join k using (lang) join kept using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = kept.term
), f as (
  select a.lang, a.source, 'pair' as part, b.source as item, sum(abs(a.p - b.p))::bigint as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  union all
  select a.lang, a.source, 'pair', b.source, 0 from g a join g b on a.lang = b.lang and a.source <> b.source where a.lang not in (select lang from k)
  union all
  select lang, source, 'term', term, p - q from p where c > 0 and p > q
), r as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from f
)
select * from r where part = 'pair' or rank <= 50
"""
