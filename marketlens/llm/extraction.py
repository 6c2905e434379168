"""Main texts of pages by wrapper induction.

Pages of one host are aligned, by simple tree matching, with the host's commonest shape, its wrapper. Every block of
text thereby falls into a slot of the wrapper. Texts that nearly all pages of the host repeat in a slot are
template, what varies is content. Varying menus, adverts and the like are told by their elements and classes; where the
wrapper marks an article, only what is aligned with it counts. A page that does not align with its host's article is
read by its own marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import bounded_batches, whole_text
from marketlens.llm.dom import aligned, parse, roles, tree_of
from marketlens.llm.url_filter import host_of
from marketlens.operators.lookup import lookup_join
from marketlens.sources.scratch import materialise

# A host needs so many pages of different content before anything is template, and so much of them must repeat a text.
MIN_PAGES = 8
MIN_SHARE = 0.9

_PARSED = "page_id long, url string, host string, shape string, nodes array<int>, texts array<string>, digest long"


def _hash(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def content_nodes(shape: str, wrapper: str) -> list[bool]:
    """Which nodes of a shape are content by their place in the wrapper: within its article (else its main element, else
    anywhere), and not left out. Without a counterpart of the article, or where only the shape marks one, its own marks decide."""
    out, own = roles(shape)
    _, theirs = roles(wrapper)
    places = aligned(shape, wrapper)
    wanted = max(theirs)
    inside, parents = [], tree_of(shape)[2]
    for node, place in enumerate(places):
        inside.append(theirs[place] if place >= 0 else inside[parents[node]] if node else 0)
    if max(own) > wanted or not any(role == wanted and not gone for role, gone in zip(inside, out)):
        inside, wanted = own, max(own)
    return [not gone and role == wanted for gone, role in zip(out, inside)]


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Shape and blocks of every page; blocks that are left out by their own marks are not kept.

    ``digest`` tells pages with different content apart.
    """
    bounded_batches(pages.sparkSession)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, nodes, texts, digests = [], [], [], []
            for page in batch.column("html").to_pylist():
                shape, owners, blocks = parse(page)
                out, _ = roles(shape)
                kept = [i for i, node in enumerate(owners) if not out[node]]
                shapes.append(shape)
                nodes.append([owners[i] for i in kept])
                texts.append([blocks[i] for i in kept])
                digests.append(_hash("\n".join(texts[-1])))
            columns = [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(shapes, pa.string())]
            columns += [pa.array(nodes, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string())), pa.array(digests, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "shape", "nodes", "texts", "digest"])

    chosen = pages.select(F.col("page_id").cast("long"), "url", host_of(F.col("url")).alias("host"), whole_text("html").alias("html"))
    return materialise(chosen.mapInArrow(parsed, _PARSED))


def induce(parsed: DataFrame) -> DataFrame:
    """host, wrapper, slots, hashes: one row per host, with the slots and hashes of its template texts."""
    commonest = F.max_by("shape", F.struct(F.col("n"), F.col("shape")))
    wrappers = parsed.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n")).groupBy("host").agg(commonest.alias("wrapper"))
    variety = parsed.select("host", "digest").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("contents"))
    hosts = materialise(wrappers.join(variety, "host"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for row in batch.to_pylist():
                places = aligned(row["shape"], row["wrapper"])
                for slot, text in {(places[node], _hash(text)) for node, text in zip(row["nodes"], row["texts"])}:
                    if slot >= 0:
                        for column, value in zip(rows, (row["host"], slot, text, row["digest"])):
                            column.append(value)
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
            columns = [pa.array(column, kind) for column, kind in zip(rows, types)]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "slot", "hash", "digest"])

    many = hosts.where(F.col("contents") >= MIN_PAGES).select("host", "wrapper")
    pages = lookup_join(parsed.select("host", "shape", "nodes", "texts", "digest"), many, "host", how="inner")
    seen = pages.mapInArrow(slots, "host string, slot int, hash long, digest long").distinct()
    counted = seen.groupBy("host", "slot", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES * MIN_SHARE)
    constant = lookup_join(counted, hosts.select("host", "contents"), "host", how="inner", written=True).where(
        F.col("n") >= F.col("contents") * MIN_SHARE
    )
    # At most as many per host as a page has blocks on average, by the share.
    template = constant.groupBy("host").agg(F.collect_list("slot").alias("slots"), F.collect_list("hash").alias("hashes"))
    return materialise(hosts.select("host", "wrapper").join(template, "host", "left"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of ``pages`` (page_id, url, html): the blocks of its main text joined by line breaks.

    Null pages count as empty and have an empty text; null urls, and those without a host, are one host. Repeated rows are
    returned as often as given; an empty table gives an empty result. Other columns are not read.
    """
    parsed = parsed_pages(pages)
    joined = lookup_join(parsed.drop("digest"), induce(parsed), "host", how="inner", written=True)

    def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, template = {}, {}
        for batch in batches:
            texts = []
            for row in batch.to_pylist():
                key = row["shape"], row["wrapper"]
                if key not in content:
                    if len(content) > 1 << 12:
                        content.clear()
                    content[key] = content_nodes(*key), aligned(*key)
                wanted, places = content[key]
                if row["slots"]:
                    if row["host"] not in template:
                        template = {row["host"]: set(zip(row["slots"], row["hashes"]))}
                    constant = template[row["host"]]
                    kept = [t for n, t in zip(row["nodes"], row["texts"]) if wanted[n] and (places[n], _hash(t)) not in constant]
                else:
                    kept = [t for n, t in zip(row["nodes"], row["texts"]) if wanted[n]]
                texts.append("\n".join(kept))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text"])

    return joined.mapInArrow(main_text, "page_id long, url string, text string")
