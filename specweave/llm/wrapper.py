"""Main text of pages by wrapper induction.

The pages of a host share wrappers.  Pages become shapes (:mod:`markup`); the most frequent shape of a host is its
wrapper, and every other shape of the host is aligned with it by simple tree matching, once a shape, not once a
page.  Over all pages of the host each place of the wrapper then shows whether its text is constant, goes
round among few texts, is made of links, or varies: the last is content.  What markup says of a place (``nav``,
``article``, class names of adverts) is part of the wrapper, and decides where a host has too few pages.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.markup import TEXT, Alignment, parsed, regions, shaped
from specweave.llm.tables import stored

LEAST_PAGES = 3  # with different content, before a text counts as constant
CONSTANT = 0.9  # of the pages that have the place
LEAST_ROUND = 20
ROUND = 0.9  # of the texts of a place stand on several pages
LINKED = 0.5  # of the characters of a place stand in links
BROADCAST_BYTES = 32 << 20

HOST = re.compile(r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)
HEADINGS = ("h1",)
_BLOCK = pa.struct([("slot", pa.int32()), ("text", pa.string()), ("digest", pa.int64()), ("linked", pa.int64())])
_PAGE = "page_id {key}, url string, host string, shape string, shape_id long, main long, blocks array<struct<slot:int,text:string,digest:long,linked:long>>"
_PLACES = "host string, shape_id long, slot int, place long, region string, heading boolean"
Rows = Iterator[pa.RecordBatch]


def _hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _pages(batches: Rows) -> Rows:
    """Pages as shapes and blocks; ``main`` is a digest of the article, or else of the longest slot."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            urls = part.column("url").to_pylist()
            shapes, mains, lists = [], [], []
            for page in part.column("html").to_pylist():
                shape, blocks = shaped(parsed(page or ""))
                shapes.append(json.dumps(shape, separators=(",", ":")))
                places = regions(shape)
                by_slot: dict[object, list[str]] = {}
                for b in blocks:
                    region = places[b.slot][0]
                    by_slot.setdefault("a" if region == "a" else b.slot, []).append(b.text)
                texts = by_slot.get("a") or max(by_slot.values(), key=lambda t: sum(map(len, t)), default=[])
                mains.append(_hashed("\n".join(texts)))
                # a slot that markup names template is never text: its digest is evidence enough
                lists.append(
                    [
                        {"slot": b.slot, "text": None if places[b.slot][0] == "t" else b.text, "digest": _hashed(b.text), "linked": b.linked}
                        for b in blocks
                    ]
                )
            found = [HOST.match(u) if u else None for u in urls]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("page_id"),
                    pa.array(urls, pa.string()),
                    pa.array([f[1].lower() if f else "" for f in found], pa.string()),
                    pa.array(shapes, pa.string()),
                    pa.array([_hashed(s) for s in shapes], pa.int64()),
                    pa.array(mains, pa.int64()),
                    pa.array(lists, pa.list_(_BLOCK)),
                ],
                ["page_id", "url", "host", "shape", "shape_id", "main", "blocks"],
            )


def _aligned(batches: Rows) -> Rows:
    """The slots of text of every shape as places of its host's wrapper."""
    wrappers: dict[str, Alignment] = {}
    for batch in batches:
        out: list[tuple] = []
        for host, name, shape, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "shape_id", "shape", "wrapper"))):
            if wrapper not in wrappers:
                wrappers.clear()
                wrappers[wrapper] = Alignment(json.loads(wrapper))
            tree = json.loads(shape)
            marks = regions(tree)
            for slot, place in enumerate(wrappers[wrapper].places(tree)):
                region, label, parent = marks[slot]
                if label == TEXT:
                    out.append((host, name, slot, place, region, parent in HEADINGS))
        types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
        columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(columns, ["host", "shape_id", "slot", "place", "region", "heading"])


def _places(pages: DataFrame) -> DataFrame:
    """``host, shape_id, slot, place, region, heading`` of all shapes, aligned with the wrapper of their host."""
    shapes = pages.groupBy("host", "shape_id").agg(F.first("shape").alias("shape"), F.count(F.lit(1)).alias("n"))
    shapes = stored(shapes)
    wrappers = shapes.groupBy("host").agg(F.max_by("shape", F.struct("n", "shape_id")).alias("wrapper"))
    rows = shapes.select("host", "shape_id", "shape").join(wrappers, "host")
    return stored(rows.mapInArrow(_aligned, _PLACES))


def _verdicts(pages: DataFrame, places: DataFrame) -> DataFrame:
    """For each shape of a host the slots that are template, and the texts that are in others.

    Every count is over different contents: copies of a page say nothing of its template.  A place goes if its
    region is template; if the host's pages mark an article and it stands outside; outside of articles also if
    most of its text is linked, or goes round.  A text goes from a place that CONSTANT of its pages show it in.
    """
    block = F.explode("blocks").alias("b")
    rows = pages.select("host", "shape_id", "main", block)
    rows = rows.select("host", "shape_id", "main", "b.slot", "b.digest", F.coalesce(F.length("b.text"), F.lit(0)).alias("chars"), "b.linked")
    key = ["host", "shape_id", "slot", "digest", "main"]
    rows = rows.groupBy(key).agg(F.max("chars").alias("chars"), F.max("linked").alias("linked"))
    texts = rows.join(places.drop("region", "heading"), ["host", "shape_id", "slot"])
    texts = texts.groupBy("host", "place", "digest", "main").agg(F.max("chars").alias("chars"), F.max("linked").alias("linked"))
    contents = texts.select("host", "place", "main").distinct().groupBy("host", "place").agg(F.count(F.lit(1)).alias("contents"))
    sums = {"n": F.count(F.lit(1)), "chars": F.sum("chars"), "linked": F.sum("linked")}
    texts = stored(texts.groupBy("host", "place", "digest").agg(*(f.alias(n) for n, f in sums.items())))
    round_ = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    found = texts.groupBy("host", "place").agg(F.sum("n").alias("shown"), round_.alias("round"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    found = stored(found.join(contents, ["host", "place"]))

    rare = F.col("contents") < LEAST_ROUND
    goes_round = ~rare & (F.col("round") >= ROUND * F.col("shown"))
    menu = (F.col("linked") > LINKED * F.col("chars")) & ~F.col("heading")
    outside = F.col("region") != "a"
    kept = F.when(F.col("region") == "t", False).when(F.col("best") != F.col("region"), False)
    kept = kept.when(outside & (F.col("region") != "m") & (menu | goes_round), False).otherwise(True)
    # the innermost region a shape has: article, main, or the whole page
    best = F.when(F.max((F.col("region") == "a").cast("int")) == 1, "a").when(F.max((F.col("region") == "m").cast("int")) == 1, "m")
    bests = places.groupBy("host", "shape_id").agg(best.otherwise("").alias("best"))
    slots = places.join(found, ["host", "place"]).join(bests, ["host", "shape_id"]).withColumn("kept", kept)
    constant = (F.col("n") >= LEAST_PAGES) & (F.col("n") >= CONSTANT * F.col("contents"))
    fixed = texts.select("host", "place", "digest", "n").join(found.select("host", "place", "contents"), ["host", "place"]).where(constant)
    fixed = fixed.groupBy("host", "place").agg(F.collect_list("digest").alias("digests"))
    slots = slots.where("kept").join(fixed, ["host", "place"], "left")
    verdict = F.struct("slot", F.coalesce("digests", F.array().cast("array<bigint>")).alias("fixed"))
    return stored(slots.groupBy("host", "shape_id").agg(F.collect_list(verdict).alias("kept")))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of ``pages`` (``page_id, url, html``), one row each.

    ``text`` holds the blocks of the page that are content, in order, one a line; references are decoded and
    white space within a block is one space.  A line break is white space, a cell of a table a block.

    A null or empty page has an empty text; a page without a host is compared with others without; repeated rows
    stay rows of their own and say nothing of a template.  Other columns are not read; no rows give none.
    """
    key = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    read = stored(rows.mapInArrow(_pages, _PAGE.format(key=key)))
    verdicts = _verdicts(read, _places(read))
    size = verdicts.agg(F.sum(64 + F.length("host") + F.expr("aggregate(kept, 0, (n, k) -> n + 32 + 8 * size(k.fixed))"))).first()[0]
    if (size or 0) <= BROADCAST_BYTES:
        verdicts = F.broadcast(verdicts)
    out = read.select("page_id", "url", "host", "shape_id", "blocks").join(verdicts, ["host", "shape_id"], "left")
    content = F.expr("filter(blocks, b -> exists(kept, k -> k.slot = b.slot and not array_contains(k.fixed, b.digest)))")
    text = F.coalesce(F.array_join(F.transform(content, lambda b: b["text"]), "\n"), F.lit(""))
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
