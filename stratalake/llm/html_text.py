"""HTML extraction by a site style tree: pages of a host are merged into one tree, and branches of low importance are left out of each page.

Elements of a host's pages with the same path (`page_tree`) are one node of its tree.  With m the pages that have a node:

* presentation: its styles are the sequences of its children's paths; NodeImp = -sum p_i log_m p_i over the styles' shares
  p_i of pages (1 for m = 1);
* content: the features of a leaf are its distinct blocks of text; a feature that stands on c pages has the entropy log_m c,
  and a leaf's importance is one minus the mean over its features; an inner node has the mean of all features below it;
* both: CompImp = (1 - GAMMA**l) * NodeImp + GAMMA**l * content, for l styles.

A branch below LOW is removed with all it holds, and so is the text of a leaf below LOW, and single blocks of a leaf that
stand on over half of its pages (of MANY at least).  Pages of a host with the same
text count once, so a page that was crawled many times does not make its own article look like a template.  Plain
paragraphs, headings and items inside an article or main element start with the weight of TRUST pages of importance 1,
as the name of their container speaks for them, and are removed as leaves only.  A leaf most of whose characters are
links is a menu.  What kind, role or name mark as menu, notice, advert, form, script or comments is noise at every host
(`page_tree.Page`); with an article or main element left, its text is the page's.

The statistics are counts by (host, node), (host, node, style) and (host, node, feature), summed before every shuffle; a
host's pages never meet in a task.  What a host's pages get is the list of its low nodes, which grows with its templates
and not with its pages; Spark sends it to all tasks below its own broadcast threshold, and joins (splitting hot hosts)
above.  Null html gives an empty text; a null url, or one without a host, makes a site of its own; repeated rows give
repeated rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import forget, stash
from .page_tree import Page

GAMMA = 0.9
LOW = 0.3
TRUST = 8
#: Share of a leaf's characters that are links, from which on it is a menu.
LINKED = 0.6
#: Pages that a leaf must have before its single blocks are judged.
MANY = 8
_NODE = "struct<node: long, above: array<long>, style: long, inner: boolean, features: array<long>, size: long, linked: long>"
_BLOCK = "struct<place: int, holder: int, feature: long, text: string>"

def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    return F.when(found != "", found)


def _digest(text: str) -> int:
    return xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1


def _parsed(source: str) -> tuple[list[tuple], list[tuple]]:
    """The nodes (one for each path) and blocks of a page outside noise; a block's place is that of its node."""
    page = Page(source)
    n, out, inner, holders = len(page.parents), page.outside(), page.inner(), page.holders()
    above, places, nodes = [()] * n, {}, []
    for i in range(n):
        if out[i]:
            continue
        p, path = page.parents[i], page.paths[i]
        above[i] = (path,) if i == 0 else above[p] if path == page.paths[p] else (*above[p], path)
        if path not in places:
            places[path] = len(nodes)
            nodes.append([path, above[i], 0, inner[i], set(), 0, 0])
        node = nodes[places[path]]
        node[2] = (node[2] * 31 + page.styles[i] + 1) & (1 << 63) - 1
    blocks = []
    for i, said, linked in page.blocks:
        if not out[i]:
            node = nodes[places[page.paths[i]]]
            node[4].add(digest := _digest(said) ^ node[0])  # a block's digest holds its leaf
            node[5] += len(said)
            node[6] += linked
            blocks.append((places[page.paths[i]], holders[i], digest, said))
    return nodes, blocks


_NODES = pa.list_(pa.struct([("node", pa.int64()), ("above", pa.list_(pa.int64())), ("style", pa.int64()), ("inner", pa.bool_()), ("features", pa.list_(pa.int64())), ("size", pa.int64()), ("linked", pa.int64())]))
_BLOCKS = pa.list_(pa.struct([("place", pa.int32()), ("holder", pa.int32()), ("feature", pa.int64()), ("text", pa.string())]))


def _nested(rows: list[list], kind: pa.ListType) -> pa.ListArray:
    """A column of lists of structs from lists of tuples."""
    flat, offsets = [x for row in rows for x in row], [0]
    for row in rows:
        offsets.append(offsets[-1] + len(row))
    columns = [pa.array([x[k] for x in flat], f.type) for k, f in enumerate(kind.value_type)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)))


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found = [_parsed(source or "") for source in part["html"].to_pylist()]
            signs = [_digest("\n".join(sorted({b[3] for b in blocks}))) for _, blocks in found]
            nodes = _nested([[(*v[:4], list(v[4]), *v[5:]) for v in nodes] for nodes, _ in found], _NODES)
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], part["host"], pa.array(signs, pa.int64()), nodes, _nested([b for _, b in found], _BLOCKS)], ["page_id", "url", "host", "sign", "nodes", "blocks"])


def parse(pages: DataFrame) -> DataFrame:
    """The nodes and blocks of every row of `pages` (page_id, url, html)."""
    ids, urls = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    pages = pages.select("page_id", "url", host_of(F.col("url").cast("string")).alias("host"), "html")
    return pages.mapInArrow(_pages, f"page_id {ids}, url {urls}, host string, sign long, nodes array<{_NODE}>, blocks array<{_BLOCK}>")


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """Of each node (host, node): pages, styles, importance of its own text (leaf) and of its branch, share of links; and
    the blocks (host, feature) that stand on most pages.

    `pages` is what `parse` gave, written.  The tables behind the frame come with it.
    """
    seen = pages.where("host is not null").select("host", "sign", "nodes")
    once = stash(seen.groupBy("host", "sign").agg(F.first("nodes").alias("nodes")).select("host", F.inline("nodes")))
    by_style = once.groupBy("host", "node", "style").agg(F.count("*").alias("c"), F.first("above").alias("above"), F.min("inner").alias("inner"), F.sum("size").alias("size"), F.sum("linked").alias("linked"))
    shape = by_style.groupBy("host", "node").agg(
        F.sum("c").alias("m"), F.count("*").alias("styles"), F.sum(F.col("c") * F.ln("c")).alias("c_ln_c"),
        F.first("above").alias("above"), F.min("inner").alias("inner"), F.sum("size").alias("size"), F.sum("linked").alias("linked"),
    )
    by_feature = once.select("host", "node", F.explode("features").alias("feature")).groupBy("host", "node", "feature").agg(F.count("*").alias("c"))
    said = by_feature.groupBy("host", "node").agg(F.count("*").alias("features"), F.sum(F.ln("c")).alias("ln_c"))
    nodes_ = stash(shape.join(said, ["host", "node"], "left").fillna(0, ["features", "ln_c"]))
    # one minus the mean entropy of features, as a sum over features
    nodes = nodes_.withColumn("kept", F.when(F.col("m") > 1, F.col("features") - F.col("ln_c") / F.ln("m")).otherwise(F.col("features")))
    below = nodes.select("host", F.explode("above").alias("node"), "features", "kept").groupBy("host", "node").agg(F.sum("features").alias("all_features"), F.sum("kept").alias("all_kept"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    look = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), 1 - F.col("c_ln_c") / F.col("m") / F.ln("m"))).otherwise(1.0)
    fade = F.pow(F.lit(GAMMA), F.col("styles"))
    leaf = share("kept", "features")
    tree = nodes.join(below, ["host", "node"]).select(
        "host", "node", "m", "styles", "features", "inner",
        F.when(F.col("inner"), (leaf * F.col("m") + TRUST) / (F.col("m") + TRUST)).otherwise(leaf).alias("leaf"),
        F.when(F.col("all_features") > 0, (1 - fade) * look + fade * share("all_kept", "all_features")).otherwise(1.0).alias("branch"),
        share("linked", "size").alias("links"),
        (F.col("size") > 0).alias("speaks"),
    )
    many = nodes_.where(~F.col("inner") & (F.col("m") >= MANY)).select("host", "node", "m")
    blocks = by_feature.join(many, ["host", "node"]).where("2 * c > m").select("host", "feature").distinct()
    return tree, blocks, (once, nodes_)


def low_nodes(tree: DataFrame, blocks: DataFrame) -> DataFrame:
    """(host, branches, leaves, lines): paths of the nodes, and digests of the blocks, that are left out."""
    leaf = F.col("speaks") & ((F.col("leaf") < LOW) | (~F.col("inner") & (F.col("links") > LINKED)))
    found = tree.where("node <> 0").select("host", "node", (~F.col("inner") & (F.col("branch") < LOW)).alias("b"), leaf.alias("l")).where("b or l")
    found = found.select("host", F.when(F.col("b"), F.col("node")).alias("branch"), F.when(F.col("l"), F.col("node")).alias("leaf"), F.lit(None).cast("long").alias("block"))
    found = found.unionByName(blocks.select("host", F.lit(None).cast("long").alias("branch"), F.lit(None).cast("long").alias("leaf"), F.col("feature").alias("block")))
    return found.groupBy("host").agg(F.collect_list("branch").alias("branches"), F.collect_list("leaf").alias("leaves"), F.collect_list("block").alias("lines"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html)."""
    parsed = stash(parse(pages))
    tree, blocks, made = style_tree(parsed)
    low = stash(low_nodes(tree, blocks))
    forget(*made)
    both = parsed.join(low, "host", "left").select("page_id", "url", "nodes", "blocks", *[F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in ("branches", "leaves", "lines")])
    out = F.transform("nodes", lambda v: F.arrays_overlap(v["above"], F.col("branches")) | F.array_contains(F.col("leaves"), v["node"]))
    good = both.withColumn("out", out).withColumn("good", F.filter("blocks", lambda b: ~(F.col("out")[b["place"]] | F.array_contains(F.col("lines"), b["feature"]))))
    held = good.withColumn("most", F.array_max(F.transform("good", lambda b: b["holder"])))
    text = F.array_join(F.transform(F.filter("good", lambda b: b["holder"] == F.col("most")), lambda b: b["text"]), " ")
    return held.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op11_html_extraction(pages: DataFrame) -> DataFrame:
    return extract(pages)
