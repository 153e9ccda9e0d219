"""Markdown notes as a graph: links, embeds, tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.plans.catalog import Catalog

_FENCE = re.compile(r"^(```|~~~).*?^\1[^\n]*$", re.M | re.S)
_CODE = re.compile(r"`[^`\n]*`")
_LINK = re.compile(r"(!?)\[\[([^\[\]|#^\n]*)(?:[#^][^\[\]|\n]*)?(?:\|([^\[\]\n]*))?\]\]")
_TAG = re.compile(r"(?<![\w/#&])#([^\W\d_][\w/-]*|\d[\w/-]*[^\W\d_][\w/-]*)")
_FRONT = re.compile(r"\A﻿?---[ \t]*\r?\n(.*?)^---[ \t]*\r?$", re.M | re.S)


def front_matter(text: str) -> tuple[dict[str, str | list[str]], str]:
    """Keys of the block at the head (scalars and flat lists), and the text behind it."""
    m = _FRONT.match(text)
    if not m:
        return {}, text
    out: dict[str, str | list[str]] = {}
    key = None
    for line in m[1].splitlines():
        if item := re.match(r"\s*-\s+(.*)", line):
            if key is not None:
                old = out.get(key)
                out[key] = [*(old if isinstance(old, list) else []), item[1].strip().strip("'\"")]
        elif pair := re.match(r"([\w-]+):\s*(.*)", line):
            key, value = pair[1], pair[2].strip()
            if value.startswith("[") and value.endswith("]"):
                out[key] = [x.strip().strip("'\"") for x in value[1:-1].split(",") if x.strip()]
            else:
                out[key] = value.strip("'\"")
    return out, text[m.end() :]


def parse_note(text: str) -> dict[str, list[str] | str | None]:
    """title, aliases, tags (with those of the front matter), links and embeds, in order of first mention."""
    front, body = front_matter(text.replace("\r\n", "\n"))
    body = _CODE.sub(" ", _FENCE.sub(" ", body))
    as_list = lambda x: x if isinstance(x, list) else [y for y in re.split(r"[,\s]+", x or "") if y]
    tags = [t.lstrip("#").rstrip("/") for t in as_list(front.get("tags", []))]
    bare = _LINK.sub(" ", body)
    tags += [t.rstrip("/") for t in _TAG.findall(bare)]
    aliases = front.get("aliases", front.get("alias", []))
    links, embeds = [], []
    for bang, target, _ in _LINK.findall(body):
        if target.strip():
            (embeds if bang else links).append(target.strip())
    title = front.get("title")
    return {
        "title": title if isinstance(title, str) and title else None,
        "aliases": aliases if isinstance(aliases, list) else [aliases],
        "tags": list(dict.fromkeys(t for t in tags if t)),
        "links": list(dict.fromkeys(links)),
        "embeds": list(dict.fromkeys(embeds)),
    }


def parse_notes(notes: DataFrame) -> DataFrame:
    """vault, path, title, aliases, tags, links, embeds of notes (vault, path, text). Null texts are empty notes."""
    fields = ("aliases", "tags", "links", "embeds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse_note(t or "") for t in b.column(2).to_pylist()]
            lists = [pa.array([f[k] for f in found], pa.list_(pa.string())) for k in fields]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f["title"] for f in found], pa.string()), *lists], ["vault", "path", "title", *fields])

    return notes.select("vault", "path", "text").mapInArrow(run, "vault string, path string, title string, aliases array<string>, tags array<string>, links array<string>, embeds array<string>")


def read_vault(spark: SparkSession, folder: str, vault: str = "vault") -> DataFrame:
    """The Markdown files below a folder as notes."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return files.select(F.lit(vault).alias("vault"), F.regexp_replace(F.input_file_name(), r"^.*?" + re.escape(folder.rstrip("/")) + "/", "").alias("path"), F.col("value").alias("text"))


def _stem(c: str):
    return F.lower(F.regexp_replace(F.regexp_extract(F.col(c), r"([^/]*)$", 1), r"(?i)\.md$", ""))


def vault_graph(notes: DataFrame, placeholders: bool = True) -> Catalog:
    """Notes, tags and their edges LINKS_TO, EMBEDS, TAGGED and SUBTAG_OF.

    A link goes to the note of its vault whose path without .md, file name or alias it names, without regard to case;
    of several the first by path. With ``placeholders`` a name that no note has becomes a note without a path, else the
    link is left out. Repeated paths count once (the greatest text).
    """
    spark = notes.sparkSession
    once = notes.where("path IS NOT NULL").groupBy(F.coalesce("vault", F.lit("")).alias("vault"), "path").agg(F.max("text").alias("text"))
    parsed = parse_notes(once)
    key = F.concat(F.col("vault"), F.lit("/"), F.col("path"))
    named = parsed.select("vault", key.alias("id"), F.explode(F.array_distinct(F.concat(F.array(_stem("path"), F.lower(F.regexp_replace("path", r"(?i)\.md$", ""))), F.transform(F.coalesce("aliases", F.array()), F.lower)))).alias("name"))
    names = named.groupBy("vault", "name").agg(F.min("id").alias("target"))
    wanted = parsed.select("vault", key.alias("src"), F.explode(F.array(F.struct(F.lit("LINKS_TO").alias("kind"), F.col("links").alias("to")), F.struct(F.lit("EMBEDS").alias("kind"), F.col("embeds").alias("to")))).alias("e")).select("vault", "src", "e.kind", F.explode("e.to").alias("to"))
    wanted = wanted.withColumn("name", F.lower(F.regexp_replace("to", r"(?i)\.md$", "")))
    linked = wanted.join(names, ["vault", "name"], "left")
    ghost = F.concat(F.col("vault"), F.lit("/?"), F.col("name"))
    if not placeholders:
        linked = linked.where(F.col("target").isNotNull())
    edges = linked.select("kind", "src", F.coalesce("target", ghost).alias("dst"))
    g = Catalog(spark)
    real = parsed.select(key.alias("id"), "vault", "path", F.coalesce("title", F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?i)\.md$", "")).alias("title"), F.lit(False).alias("placeholder"))
    missing = linked.where(F.col("target").isNull()).groupBy(ghost.alias("id")).agg(F.min("vault").alias("vault"), F.lit(None).cast("string").alias("path"), F.min("to").alias("title"), F.lit(True).alias("placeholder"))
    g.register_nodes("Note", real.unionByName(missing) if placeholders else real, F.col("id"))
    tags = parsed.select(key.alias("src"), F.explode("tags").alias("tag")).withColumn("tag", F.lower("tag"))
    # a tag a/b/c stands below a/b, and that below a
    parts = F.split("tag", "/")
    chain = tags.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("tag")).distinct()
    g.register_nodes("Tag", chain.select(F.concat(F.lit("#"), "tag").alias("id"), F.col("tag").alias("name")), F.col("id"))
    for kind in ("LINKS_TO", "EMBEDS"):
        g.register_edges(kind, edges.where(F.col("kind") == kind).select("src", "dst"), F.col("src"), F.col("dst"), "Note", "Note")
    g.register_edges("TAGGED", tags.select("src", F.concat(F.lit("#"), "tag").alias("dst")), F.col("src"), F.col("dst"), "Note", "Tag")
    up = chain.where(F.col("tag").contains("/")).select(F.concat(F.lit("#"), "tag").alias("src"), F.concat(F.lit("#"), F.regexp_replace("tag", "/[^/]*$", "")).alias("dst"))
    g.register_edges("SUBTAG_OF", up, F.col("src"), F.col("dst"), "Tag", "Tag", True)
    return g


def hash_embedding(texts: DataFrame, key: str, text: str, dimension: int = 256) -> DataFrame:
    """key, embedding: signed feature hashing of the tokens by FNV-1a (its constants are fixed values), unit length."""
    from weft.search.text import tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}

        def place(token: str) -> tuple[int, float]:
            h = 0xCBF29CE484222325
            for byte in token.encode():
                h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            if len(known) > 500_000:
                known.clear()
            known[token] = at = (h % dimension, 1.0 if h >> 63 == 0 else -1.0)
            return at

        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                v = np.zeros(dimension, np.float64)
                for token in tokens(t or ""):
                    i, sign = known.get(token) or place(token)
                    v[i] += sign
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], [key, "embedding"])

    return texts.select(key, text).mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, embedding array<float>")


def vault_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """vault, path, change (added, changed, removed) between two states of notes (vault, path, text).

    Null and empty texts are the same; of repeated paths the greatest text counts.
    """
    one = lambda df, c: df.where("path IS NOT NULL").groupBy(F.coalesce("vault", F.lit("")).alias("vault"), "path").agg(F.md5(F.max(F.coalesce("text", F.lit("")))).alias(c))
    both = one(old, "was").join(one(new, "is"), ["vault", "path"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select("vault", "path", change.alias("change")).where(F.col("change").isNotNull())


def backlinks(g: Catalog, note: str) -> DataFrame:
    """Notes that link to or embed a note, by its id."""
    from weft.session import GraphSession

    return GraphSession(g.spark, g).cypher("MATCH (a:Note)-[r:LINKS_TO|EMBEDS]->(b:Note) WHERE id(b) = $n RETURN id(a) AS note, type(r) AS type", {"n": note})


def orphans(g: Catalog) -> DataFrame:
    """Notes without any link, in either direction."""
    from weft.session import GraphSession

    return GraphSession(g.spark, g).cypher("MATCH (n:Note) WHERE NOT n.placeholder AND NOT (n)-[:LINKS_TO|EMBEDS]-() RETURN id(n) AS note")


def vault_sync(old: DataFrame, new: DataFrame, prune: bool = True) -> tuple[DataFrame, DataFrame]:
    """The notes after taking over a new state, and what changed (as vault_diff). Without ``prune`` notes that are no
    longer there stay. Unchanged notes keep their old rows."""
    changes = vault_diff(old, new)
    if not prune:
        changes = changes.where("change <> 'removed'")
    key = [F.coalesce("vault", F.lit("")), F.col("path")]
    mark = lambda df: df.where("path IS NOT NULL").withColumn("__v", key[0])
    touched = changes.select(F.col("vault").alias("__v"), "path", "change")
    kept = mark(old).join(touched, ["__v", "path"], "left_anti")
    taken = mark(new).join(touched.where("change <> 'removed'"), ["__v", "path"], "left_semi")
    return kept.select("vault", "path", "text").unionByName(taken.select("vault", "path", "text")), changes


def _ask(g: Catalog, text: str, **params: str) -> DataFrame:
    from weft.session import GraphSession

    return GraphSession(g.spark, g).cypher(text, params)


def list_notes(g: Catalog) -> DataFrame:
    return _ask(g, "MATCH (n:Note) WHERE NOT n.placeholder RETURN id(n) AS note, n.title AS title ORDER BY note")


def note_neighbours(g: Catalog, note: str) -> DataFrame:
    """Notes linked with a note in either direction, with the kind of link."""
    return _ask(g, "MATCH (a:Note)-[r:LINKS_TO|EMBEDS]-(b:Note) WHERE id(a) = $note RETURN DISTINCT id(b) AS note, type(r) AS type", note=note)


def list_tags(g: Catalog) -> DataFrame:
    return _ask(g, "MATCH (t:Tag) OPTIONAL MATCH (n:Note)-[:TAGGED]->(t) RETURN t.name AS tag, count(n) AS notes ORDER BY tag")


def notes_with_tag(g: Catalog, tag: str) -> DataFrame:
    """Notes with a tag or one below it."""
    return _ask(g, "MATCH (n:Note)-[:TAGGED]->(t:Tag) WHERE t.name = $tag OR t.name STARTS WITH $below RETURN DISTINCT id(n) AS note", tag=tag.lower().lstrip("#"), below=tag.lower().lstrip("#") + "/")
