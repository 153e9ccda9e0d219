"""Full-text search: tokens with places, phrases, prefixes, BM25."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.cypher.ast import CypherError
from weft.plans.catalog import Catalog
from weft.search.filters import apply_filter, settings
from weft.storage import Scratch

#: Fixed values of the ranking, and the number of vocabulary terms that a prefix stands for at most (the first in order).
K1, B, PREFIX_TERMS = 1.5, 0.75, 64
_RUN = re.compile(r"[^\W_]+")
#: Scripts written without blanks; their runs are cut into pairs of signs.
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]+")


def tokens(text: str) -> list[str]:
    """Lower-case runs of letters and digits, in order; CJK runs as overlapping pairs."""
    out: list[str] = []
    for run in _RUN.findall(text.lower()):
        at = 0
        for m in _CJK.finditer(run):
            if m.start() > at:
                out.append(run[at : m.start()])
            s = m.group()
            out += [s[i : i + 2] for i in range(len(s) - 1)] or [s]
            at = m.end()
        if at < len(run):
            out.append(run[at:])
    return out


def parse_query(text: str) -> tuple[list[str], list[str], list[list[str]]]:
    """Plain terms, prefixes and phrases; a phrase's terms count as plain terms too."""
    phrases = [p for p in (tokens(m) for m in re.findall(r'"([^"]*)"', text)) if p]
    rest = re.sub(r'"[^"]*"', " ", text)
    prefixes = [t[-1] for m in re.findall(r"(\S+)\*", rest) if (t := tokens(m))]
    plain = tokens(re.sub(r"\S+\*", " ", rest))
    return list(dict.fromkeys(plain + [t for p in phrases for t in p])), list(dict.fromkeys(prefixes)), phrases


def matching_terms(docs: DataFrame, terms: list[str], prefixes: list[str], phrases: list[list[str]], columns: list[str]) -> DataFrame:
    """id, length, counts (map of term to occurrences) and phrases (whether all stand there); one scan of the texts.

    The counts hold the query's terms only, and all terms with one of its prefixes.
    """
    kind = dict(docs.dtypes)["id"]
    wanted, starts = set(terms), tuple(prefixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, counts, whole = [], [], []
            for texts in zip(*[b.column(i + 1).to_pylist() for i in range(len(columns))]):
                fields = [tokens(t) for t in texts if t]
                n: dict[str, int] = {}
                for ts in fields:
                    for t in ts:
                        if t in wanted or starts and t.startswith(starts):
                            n[t] = n.get(t, 0) + 1
                lengths.append(sum(map(len, fields)))
                counts.append(list(n.items()))
                whole.append(all(any(ts[i : i + len(p)] == p for ts in fields for i in range(len(ts) - len(p) + 1)) for p in phrases))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), pa.array(counts, pa.map_(pa.string(), pa.int64())), pa.array(whole, pa.bool_())], ["id", "length", "counts", "phrases"])

    return docs.select("id", *[F.col(f"`{c}`").cast("string") for c in columns]).mapInArrow(run, f"id {kind}, length long, counts map<string,long>, phrases boolean")


def bm25(docs: DataFrame, columns: list[str], query: str) -> DataFrame:
    """id, score of all documents that hold a query term (and all phrases).

    Documents without any token count neither for N nor for the mean length. The document frequencies of the query's
    terms come from one aggregate; prefixes stand for the first terms of the vocabulary that begin so.
    """
    terms, prefixes, phrases = parse_query(query)
    spark = docs.sparkSession
    empty = spark.createDataFrame([], f"id {dict(docs.dtypes)['id']}, score double")
    if not terms and not prefixes:
        return empty
    found = Scratch(spark, "bm25").write(matching_terms(docs, terms, prefixes, phrases, columns).where("length > 0"))
    n, mean = found.agg(F.count(F.lit(1)), F.avg("length")).first()
    if not n:
        return empty
    exploded = found.select(F.explode(F.map_keys("counts")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    df: dict[str, int] = {}
    if terms:
        df = {r.t: r.df for r in exploded.where(F.col("t").isin(terms)).collect()}
    for p in prefixes:
        df |= {r.t: r.df for r in exploded.where(F.col("t").startswith(p)).orderBy("t").limit(PREFIX_TERMS).collect()}
    if not df:
        return empty
    norm = K1 * (1 - B + B * F.col("length") / F.lit(float(mean)))
    total = F.lit(0.0)
    for t in sorted(df):
        tf = F.coalesce(F.try_element_at("counts", F.lit(t)), F.lit(0)).cast("double")
        idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
        total = total + idf * tf * (K1 + 1) / (tf + norm)
    hit = F.arrays_overlap(F.map_keys("counts"), F.array(*[F.lit(t) for t in sorted(df)]))
    return found.where(hit & F.col("phrases")).select("id", total.alias("score"))


def properties(c: dict[str, Any]) -> list[str]:
    p = c.get("text_properties", c.get("text_property"))
    if p is None:
        raise CypherError("a text search needs text_property")
    return [p] if isinstance(p, str) else list(p)


def search_bm25(g: Catalog, config: dict[str, Any]) -> DataFrame:
    """The corpus for the statistics is the whole label; the filter comes after. Without k all hits are given."""
    c = settings(dict(config), {"label", "query"}, {"k", "filter", "text_property", "text_properties"})
    rows = g.scan((c["label"],))
    columns = [p for p in properties(c) if p in rows.columns]
    if not columns:
        return g.spark.createDataFrame([], f"node {g.id_type()}, score double")
    hits = bm25(rows, columns, c["query"])
    if c.get("filter"):
        hits = hits.join(apply_filter(rows, c["filter"]).select("id"), "id", "left_semi")
    hits = hits.orderBy(F.desc("score"), "id")
    return (hits.limit(c["k"]) if c.get("k") is not None else hits).withColumnRenamed("id", "node")
