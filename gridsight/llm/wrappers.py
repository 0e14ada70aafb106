"""HTML extraction by wrappers: union-free expressions inferred from all pages of a host.

1. Every page becomes an expression of its own (``markup``): repeated children are folded into groups.
   Its signature and its texts, numbered by text slot, are saved.
2. The distinct signatures of a host are aligned one after another; what only some have becomes
   optional, what repeats becomes a repeated group, texts become slots. Pages with equal signatures
   are met once, and signatures are first aligned in SPLITS parts, so a hot host is no hot task.
3. Counts over all pages tell where the bulk of the text is. Each signature has its own choice of article slots,
   by its own elements and these counts, so a host may have several templates.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from gridsight.functions.scale import saved
from gridsight.llm import markup
from gridsight.llm.batches import pieces

SPLITS = 8
#: A slot outside of named articles that is not repeated and holds the same text on all its pages, with at least so many
#: different texts around it, is fixed wording. Copies of a page count once.
FIXED_PAGES = 20
#: Share of a host's text that one child must hold to be looked into, where no element names the article.
BULK = 0.7

# Elements and words in class, id or role of parts that are not the article.
_OUTSIDE = frozenset("head nav header footer aside form button select dialog menu object audio video canvas".split())
_OUTSIDE_WORDS = re.compile(
    r"(?:^|[-_])(?:nav|navbar|navigation|menu|masthead|banner|footer|sidebar|aside|complementary|ad|ads|advert|advertisement|sponsor|"
    r"sponsored|promo|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|comment|comments|reply|replies|respond|disqus|share|sharing|social|"
    r"related|recommended|breadcrumb|breadcrumbs|newsletter|subscribe|signup|login|search|widget|toolbar|pagination|pager|hidden|contentinfo)(?:$|[-_])|^(?:side|form)$")
_HEADER_WORD = re.compile(r"(?:^|[-_])header(?:$|[-_])")
# Such words tell what a page has or lacks, not what the element is.
_ABOUT = re.compile(r"^(?:has|with|no|not|without|is)[-_]")
_ARTICLE_WORDS = re.compile(r"(?:^|[-_])(?:article|articlebody|main)(?:$|[-_])|^(?:post|entry|story|page)[-_](?:content|body|text)$|^content$")


@functools.lru_cache(100_000)
def outside(path: tuple[str, ...]) -> bool:
    """Whether a path leads into a menu, header, footer, advert or the like. An article's own header belongs to it."""
    within = False
    for key in path:
        tag, *words = key.split(".")
        if tag in ("html", "body", "page"):
            continue
        words = [w for w in words if not _ABOUT.search(w)]
        header = tag == "header" or any(_HEADER_WORD.search(w) for w in words)
        if header and not within or tag in _OUTSIDE and tag != "header" or any(_OUTSIDE_WORDS.search(w) for w in words):
            return True
        within |= tag == "article"
    return False


def names_article(key: str) -> bool:
    tag, *words = key.split(".")
    return tag in ("article", "main") or tag not in ("html", "body", "page") and any(_ARTICLE_WORDS.search(w) for w in words)


def article_slots(page: markup.Node, plain: dict[int, float], fixed: set[int]) -> set[int]:
    """The slots of a page's expression that hold the article. ``plain``: characters outside of links by slot; ``fixed``: slots of fixed wording.

    If elements of the page name the article, it is what lies in those of them that hold text; else the smallest
    element that holds the bulk of the text outside of links, less its fixed wording. What is outside is left out.
    """
    paths = [(n, p) for n, p, _ in markup.slots(page) if not outside(p)]
    named = {n for n, p in paths if any(names_article(k) for k in p)}
    if any(plain.get(n) for n in named):
        return named
    chosen, depth = {n for n, _ in paths}, 1
    total = sum(plain.get(n, 0) for n in chosen)
    while total:
        below: dict[tuple, set[int]] = {}
        for n, p in paths:
            if n in chosen and len(p) > depth:
                below.setdefault(p[:depth + 1], set()).add(n)
        best = max(below.values(), key=lambda s: sum(plain.get(n, 0) for n in s), default=set())
        if not best or sum(plain.get(n, 0) for n in best) < BULK * total or any(k.split(".")[0] in ("p", "ul", "ol", "table", "h1", "blockquote")
                                                                                for n, p in paths if n in best for k in p[depth:depth + 1]):
            break
        chosen, depth = best, depth + 1
    return chosen - fixed


def parsed_pages(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Key, url, host, signature and its hash, and the texts of each page with their slots and blocks.

    ``payload`` is a hash of the texts that are not outside of the article by their path.
    """
    source = pages.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"),
                          F.col(f"`{url}`").cast("string").alias("url"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                signatures, numbers, blocks, texts, payloads = [], [], [], [], []
                for page in piece.column(1).to_pylist():
                    root, found = markup.parse(page)
                    signatures.append(markup.write(markup.fold(root)))
                    numbers.append([s.final().number for s, _, _ in found])
                    blocks.append([b for _, b, _ in found])
                    texts.append([t.encode("utf-8", "replace").decode() for _, _, t in found])
                    inside = {n for n, p, _ in markup.slots(root) if not outside(p)}
                    words = " ".join("".join(t if n in inside else " " for n, t in zip(numbers[-1], texts[-1])).split())
                    payloads.append(xxhash.xxh64_intdigest(words) - (1 << 63))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(2), pa.array(signatures, pa.string()), pa.array(numbers, pa.list_(pa.int32())),
                     pa.array(blocks, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string())), pa.array(payloads, pa.int64())],
                    ["key", "url", "signature", "slots", "blocks", "texts", "payload"])

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    return saved(source.mapInArrow(run, f"key {kind}, url string, signature string, slots array<int>, blocks array<int>, texts array<string>, payload bigint")
                 .withColumn("host", host).withColumn("shape", F.xxhash64("signature")))


def infer(signatures: DataFrame) -> DataFrame:
    """``(host, wrapper)``: the expression that covers all signatures of each host, written out."""
    def cover(part: pa.Table) -> pa.Table:
        whole = None
        for text in sorted(part.column("signature").to_pylist(), key=lambda s: (-len(s), s)):
            one = markup.read(text)
            whole = one if whole is None else markup.merge(whole, one)
        return pa.table([part.column("host").slice(0, 1), pa.array([markup.write(whole)], pa.string())], names=["host", "signature"])

    parts = signatures.select("host", "signature", F.pmod("shape", F.lit(SPLITS)).alias("part"))
    some = parts.groupBy("host", "part").applyInArrow(cover, "host string, signature string")
    return some.groupBy("host").applyInArrow(cover, "host string, signature string").withColumnRenamed("signature", "wrapper")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, url, text, wrapper)``: the main text of each page by the wrapper of its host, and the wrapper.

    White space within a block becomes one space, blocks follow each other in page order, one per line,
    and nothing else is dropped. Null and empty pages have an empty text. Pages without url or host
    share the wrapper of the empty host. Null and repeated keys are separate rows; other columns are ignored.
    """
    parsed = parsed_pages(pages, key, url, html)
    shapes = saved(parsed.groupBy("host", "shape").agg(F.first("signature").alias("signature"), F.count("*").alias("pages")))
    wrappers = saved(infer(shapes))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for signature, text in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                page, wrapper = markup.read(signature), markup.read(text)
                found = markup.match(page, wrapper)
                once = {n for n, _, repeated in markup.slots(wrapper) if not repeated}
                paths = {n: p for n, p, _ in markup.slots(page)}
                fills = [found.get(n, -1) for n in range(len(paths))]
                rows.append((fills, [any(k.split(".")[0] == "a" for k in paths[n]) for n in range(len(paths))], [f in once for f in fills]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                 *[pa.array([r[i] for r in rows], pa.list_(pa.bool_())) for i in (1, 2)]],
                ["host", "shape", "signature", "pages", "fills", "links", "once"])

    fitted = saved(shapes.join(wrappers, "host").select("host", "shape", "signature", "pages", "wrapper").mapInArrow(
        fit, "host string, shape bigint, signature string, pages bigint, fills array<int>, links array<boolean>, once array<boolean>"))

    # One row per page and slot: its text as a hash, its length.
    filled = parsed.select("host", "shape", F.posexplode("texts").alias("at", "text"), "slots").select(
        "host", "shape", F.element_at("slots", F.col("at") + 1).alias("slot"), F.xxhash64("text").alias("hash"), F.char_length(F.trim("text")).alias("chars"))
    by_shape = saved(filled.filter("chars > 0").groupBy("host", "shape", "slot").agg(
        F.count("*").alias("texts"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.sum("chars").alias("chars")))
    at = F.col("slot") + 1
    counted = by_shape.join(fitted.drop("signature"), ["host", "shape"]).select(
        "host", "shape", "pages", "slot", F.element_at("fills", at).alias("fills"), F.element_at("once", at).alias("once"), "texts", "low", "high",
        F.when(F.element_at("links", at), 0).otherwise(F.col("chars")).alias("plain"))
    # A slot of the wrapper: what a page that has it holds there, and whether it always holds the same text.
    stats = saved(counted.filter("fills >= 0").groupBy("host", "fills").agg(
        (F.sum("plain") / F.sum("pages")).alias("plain"),
        (F.bool_or("once") & (F.min("low") == F.max("high")) & (F.sum("texts") >= FIXED_PAGES)).alias("same")))
    # The different pages around such a slot; of those of one signature FIXED_PAGES are enough.
    few = W.partitionBy("host", "shape").orderBy("payload")
    payloads = parsed.select("host", "shape", "payload").distinct().withColumn("_row", F.row_number().over(few)).filter(F.col("_row") <= FIXED_PAGES).drop("_row")
    around = (counted.filter(F.col("once") & (F.col("low") == F.col("high"))).join(stats.filter("same"), ["host", "fills"], "left_semi")
              .select("host", "shape", "fills").join(payloads, ["host", "shape"]).groupBy("host", "fills").agg(F.countDistinct("payload").alias("different")))
    fixed = around.filter(F.col("different") >= FIXED_PAGES).select("host", "fills", F.lit(True).alias("fixed"))
    by_host = stats.join(fixed, ["host", "fills"], "left").groupBy("host").agg(F.collect_list(F.struct("fills", "plain", "fixed")).alias("stats"))
    own = counted.groupBy("host", "shape").agg(F.collect_list(F.struct("slot", (F.col("plain") / F.col("pages")).alias("plain"))).alias("own"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for host, signature, fills, own, stats in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                seen = {s["fills"]: s for s in stats or []}
                plain = {s["slot"]: s["plain"] for s in own or []}
                if host:  # pages without host are no evidence for each other
                    plain |= {n: seen[f]["plain"] for n, f in enumerate(fills) if n in plain and f in seen}
                article = article_slots(markup.read(signature), plain, {n for n, f in enumerate(fills) if f in seen and seen[f]["fixed"]})
                kept.append([n in article for n in range(len(fills))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.list_(pa.bool_()))], ["host", "shape", "keep"])

    keep = saved(fitted.join(own, ["host", "shape"], "left").join(by_host, "host", "left").select("host", "shape", "signature", "fills", "own", "stats")
                 .mapInArrow(choose, "host string, shape bigint, keep array<boolean>"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for slots, blocks, texts, kept in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                lines: dict[int, list[str]] = {}
                for slot, block, text in zip(slots, blocks, texts):
                    if kept[slot]:
                        lines.setdefault(block, []).append(text)
                done.append("\n".join(line for parts in lines.values() if (line := " ".join("".join(parts).split()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.string()), batch.column(6)],
                                             ["key", "url", "text", "host"])

    rows = parsed.join(keep, ["host", "shape"]).select("key", "url", "slots", "blocks", "texts", "keep", "host")
    kind = parsed.schema["key"].dataType.simpleString()
    return rows.mapInArrow(assemble, f"key {kind}, url string, text string, host string").withColumnRenamed("key", key)
