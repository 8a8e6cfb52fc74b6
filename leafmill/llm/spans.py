"""Problem 8: long exact spans shared between documents.

Documents meet through winnowed fingerprints: of any MIN_SPAN characters the least hash of a
GRAM-gram in them is chosen, which hangs on these characters alone, so documents that share a span
share a fingerprint whose surroundings, a fragment, hold the span. Copies of a fragment form a class,
of which two stand in for all. The fragments of the fingerprints that several documents have are
dealt into shards of bounded size. In a shard the fragments of each fingerprint are numbered; for
each bit of the numbers an FM-index of those without the bit is built, and those with it are streamed
through it, so that any two meet and none meets itself. Where the matching statistics reach
MIN_SPAN, the interval of the suffix array names the fragments that share the span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.codepoints import slices, to_codepoints
from leafmill.llm.fmindex import FMIndex
from leafmill.plans import cut

MIN_SPAN = 240
GRAM = 120
#: Fragments of one fingerprint in a block, and characters aimed at in a shard.
BLOCK = 1500
SHARD_CHARS = 1 << 19
#: Partitions of the shards at most; more shards share them.
MOST_PARTITIONS = 1 << 14
#: A fingerprint with more than this share of all places is joined by itself; there are fewer than 1 / HEAVY of them.
HEAVY = 1 / 4096

_B = 0xD1342543DE82EF95
_BINV = pow(_B, -1, 1 << 64)
_TABLE = np.random.default_rng(5).integers(0, 2**63, 1 << 16, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 20) - 1, base, np.uint64)]))
        _powers[base] = have
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    return h ^ h >> np.uint64(27)


def fingerprints(cp: np.ndarray, at: np.ndarray, span: int = MIN_SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, fingerprint, place in the row and hash of the surroundings of the winnowed grams: in each `span` characters of a row the least, the last of equals."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    n = len(cp)
    if n < span:
        return none
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[(cp ^ (cp >> 16) * 40503) & 0xFFFF] * _power(_B, n), out=total[1:])
    back = _power(_BINV, n + 1)
    h = _mixed((total[gram:] - total[:-gram]) * back[: n - gram + 1])
    m = len(h)
    mask = np.uint64(0xFFFFFF)
    low = (h & ~mask) | (mask - (np.arange(m, dtype=np.uint64) & mask))
    width, have = span - gram + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: m - width + 1], low[width - have :][: m - width + 1])
    j = np.arange(len(low))
    ok = np.zeros(len(low) + 1, np.int8)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= span:
            ok[a] += 1
            ok[b - span + 1] -= 1
    j = j[np.cumsum(ok[:-1]) > 0]
    if len(j) == 0:
        return none
    place = j + (((mask - (low[j] & mask)).astype(np.int64) - j) & 0xFFFFFF)
    place = np.unique(place)
    fp = h[place].view(np.int64)
    # Periodic text repeats a fingerprint at even gaps. Of such a run the ends do, and places so near
    # that any `span` characters with a gram of the run hold a kept one.
    if len(place) > 2:
        gap = np.diff(place, prepend=-1)
        on = np.append(False, fp[1:] == fp[:-1]) & (gap <= (span - gram) // 2)
        start = ~on | (on & np.append(False, on[:-1]) & (gap != np.append(0, gap[:-1])))
        first = np.maximum.accumulate(np.where(start, np.arange(len(place)), 0))
        step = np.append(gap[1:], 1)[first]
        every = np.maximum(1, (span - gram) // np.maximum(step, 1) - 1)
        keep = ((np.arange(len(place)) - first) % every == 0) | np.append(start[1:], True)
        place, fp = place[keep], fp[keep]
    row = np.searchsorted(at, place, "right") - 1
    start, end = np.maximum(at[row], place - (span - gram)), np.minimum(at[row + 1], place + span)
    around = _mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    return row, fp, place - at[row], around.view(np.int64)


def _anchors(documents: DataFrame) -> DataFrame:
    """doc_id, fp, pos and fh (hash of the fragment) of every fingerprint of every document that is long enough."""
    long = documents.where(F.length("text") >= MIN_SPAN).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                row, fp, pos, fh = fingerprints(*to_codepoints(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(fp), pa.array(pos.astype(np.int32)), pa.array(fh)], ["doc_id", "fp", "pos", "fh"])

    return long.mapInArrow(run, "doc_id bigint, fp bigint, pos int, fh bigint")


def _meeting(documents: DataFrame) -> DataFrame:
    """doc_id, pos, fp and class of the places of fingerprints that several documents have."""
    anchors = cut(_anchors(documents))
    counted = cut(anchors.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("fp", "n"))
    heavy = F.col("n") > F.lit(anchors.count() * HEAVY)
    few = counted.where(heavy).select("fp")  # fewer than 1 / HEAVY rows, whatever the input
    rest = counted.where(~heavy).select("fp")
    met = anchors.join(F.broadcast(few), "fp").unionByName(anchors.join(rest, "fp"))
    return cut(met.select("doc_id", "pos", "fp", F.xxhash64("fp", "fh").alias("cls")))


def _fragments(documents: DataFrame, meeting: DataFrame) -> DataFrame:
    """shard, fp, cls, a and b (least and greatest document of the class) and text of a fragment of each class."""
    classes = meeting.groupBy("fp", "cls").agg(F.min(F.struct("doc_id", "pos")).alias("rep"), F.max("doc_id").alias("b"))
    classes = cut(classes.select("fp", "cls", F.col("rep.doc_id").alias("doc_id"), F.col("rep.pos").alias("pos"), "b"))
    shards = max(1, -(-classes.count() * (2 * MIN_SPAN - GRAM) // SHARD_CHARS))
    parts = min(shards, MOST_PARTITIONS)  # given, for shards of few bytes are long work
    start = f"greatest(pos - {MIN_SPAN - GRAM}, 0)"
    fetched = documents.join(classes, "doc_id").select("fp", "cls", F.col("doc_id").alias("a"), "b", F.expr(f"pos - {start}").alias("at"), F.expr(f"substring(text, {start} + 1, pos + {MIN_SPAN} - {start})").alias("text"))
    many = cut(classes.groupBy("fp").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK).select("fp"))
    out = ["shard", "fp", "cls", "a", "b", "text"]
    usual = F.pmod(F.xxhash64("fp"), F.lit(shards))
    if many.isEmpty():
        return fetched.withColumn("shard", usual).select(*out).repartition(parts, "shard")
    # A span of MIN_SPAN characters with the gram in it holds half of the rest before or behind the
    # gram, so fragments that share one agree in that half: they meet under it. What is still too
    # many is split into blocks, and each pair of blocks is a shard.
    half = (MIN_SPAN - GRAM) // 2
    fetched = cut(fetched)
    split = fetched.join(many, "fp")
    left = F.when(F.col("at") >= half, F.xxhash64("fp", F.lit("before"), F.expr(f"substring(text, at + 1 - {half}, {half})")))
    right = F.xxhash64("fp", F.lit("behind"), F.expr(f"substring(text, at + 1 + {GRAM}, {half})"))
    keyed = split.withColumn("key", F.explode(F.array_compact(F.array(left, right))))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("mine")) * F.col("blocks") + F.greatest(o, F.col("mine")))
    dealt = keyed.join(sizes, "key").withColumn("mine", mine).withColumn("pair", F.explode(pairs)).withColumn("fp", F.xxhash64("key", "pair"))
    # The fragments of small halves share a shard, as those of small fingerprints do.
    return fetched.join(many, "fp", "left_anti").withColumn("shard", usual).select(*out).unionByName(dealt.withColumn("shard", usual).select(*out)).repartition(parts, "shard")


def _levels(fp: np.ndarray, entry: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entries to index and to stream for each bit of their number among those of their fingerprint: any two of one fingerprint are on different sides once."""
    order = np.argsort(fp, kind="stable")
    sorted_fp = fp[order]
    first = np.concatenate([[True], sorted_fp[1:] != sorted_fp[:-1]]) if len(fp) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    number = np.arange(len(fp)) - begin[np.cumsum(first) - 1] if len(fp) else order
    size = np.diff(np.append(begin, len(fp)))[np.cumsum(first) - 1] if len(fp) else order
    bit = 0
    while len(size) and (live := size > 1 << bit).any():
        side = number >> bit & 1
        yield entry[order[live & (side == 0)]], entry[order[live & (side == 1)]]
        bit += 1


def shard_links(fp: np.ndarray, low: np.ndarray, high: np.ndarray, texts: list[str], span: int = MIN_SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Of one shard, whose classes have documents from `low` to `high`: pairs of classes (rows i <= j) that share `span` characters and belong to several documents, and (class, start, end) of what each shares."""
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    # A class of several documents stands twice, so that it meets a copy of itself.
    entry = np.concatenate([np.arange(len(fp)), np.flatnonzero(low < high)])
    links, spans = [np.zeros((0, 2), np.int64)], [np.zeros((0, 3), np.int64)]
    for indexed, streamed in _levels(fp[entry], entry):
        inside = np.unique(indexed)
        index = FMIndex([codes[i] for i in inside], span)
        outside = np.unique(streamed)
        hits = []
        for who, where, length, lo, hi, moved in index.matching_statistics([codes[i] for i in outside], span):
            full = np.flatnonzero(length >= span)
            if len(full):
                hits.append(np.stack([who[full], where[full], lo[full], hi[full], moved[full]], 1))
        if not hits:
            continue
        hit = np.concatenate(hits)
        hit = hit[np.lexsort((-hit[:, 1], hit[:, 0]))]
        # Rows that have only moved on name the same fragments: one interval of each stretch is looked up.
        fresh = np.concatenate([[True], (hit[1:, 0] != hit[:-1, 0]) | (hit[1:, 1] != hit[:-1, 1] - 1) | (hit[1:, 4] == 0)])
        top = np.flatnonzero(fresh)
        far = np.append(top[1:], len(hit)) - 1 - top
        width = hit[top, 3] - hit[top, 2]
        each = np.repeat(np.arange(len(top)), width)
        rows = np.repeat(hit[top, 2], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        place = index.locate(rows)
        frag = np.searchsorted(index.at, place, "right") - 1
        a, b = outside[hit[top, 0]][each], inside[frag]
        ok = np.minimum(low[a], low[b]) < np.maximum(high[a], high[b])
        a, b, each, off = a[ok], b[ok], each[ok], (place - index.at[frag])[ok]
        links.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
        here, back = hit[top, 1][each], far[each]
        spans += [np.stack([a, here - back, here + span], 1), np.stack([b, off - back, off + span], 1)]
    return np.unique(np.concatenate(links), axis=0), _joined(np.concatenate(spans))


def _joined(spans: np.ndarray) -> np.ndarray:
    """(class, start, end) with those of a class that overlap or touch made one."""
    if len(spans) == 0:
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    wide = int(spans[:, 2].max()) + 1
    end = np.maximum.accumulate(spans[:, 0] * wide + spans[:, 2])
    new = np.concatenate([[True], spans[1:, 0] * wide + spans[1:, 1] > end[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], spans[first, 1], end[np.append(first[1:], len(spans)) - 1] - spans[first, 0] * wide], 1)


def _by_shard(documents: DataFrame, meeting: DataFrame, want: str) -> DataFrame:
    names, schema = (["x", "y"], "x bigint, y bigint") if want == "links" else (["cls", "start", "end"], "cls bigint, start int, `end` int")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cls = pdf.cls.to_numpy()
        links, spans = shard_links(pdf.fp.to_numpy(), pdf.a.to_numpy(), pdf.b.to_numpy(), pdf.text.tolist())
        if want == "links":
            return pd.DataFrame({"x": cls[links[:, 0]], "y": cls[links[:, 1]]})
        return pd.DataFrame(dict(zip(names, (cls[spans[:, 0]], spans[:, 1], spans[:, 2]), strict=True)))

    return _fragments(documents, meeting).groupBy("shard").applyInPandas(run, schema)


def _known(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id is not null and text is not null").select("doc_id", "text")


def found(documents: DataFrame) -> DataFrame:
    """Each pair doc_a < doc_b of documents with MIN_SPAN characters in common on end. Null and shorter texts pair with none."""
    documents = _known(documents)
    meeting = _meeting(documents)
    links = _by_shard(documents, meeting, "links").distinct()
    members = meeting.select("cls", "doc_id").distinct()
    pairs = links.join(members.select(F.col("cls").alias("x"), F.col("doc_id").alias("d")), "x").join(members.select(F.col("cls").alias("y"), F.col("doc_id").alias("e")), "y").where("d <> e")
    return pairs.select(F.least("d", "e").alias("doc_a"), F.greatest("d", "e").alias("doc_b")).distinct()


def passages(documents: DataFrame) -> DataFrame:
    """doc_id, start, end (in characters) of the longest stretches made of spans that other documents share, overlapping ones joined."""
    documents = _known(documents)
    meeting = _meeting(documents)
    begin = F.greatest(F.col("pos") - (MIN_SPAN - GRAM), F.lit(0))
    spans = _by_shard(documents, meeting, "spans").distinct().join(meeting.select("doc_id", "cls", begin.alias("begin")).distinct(), "cls")
    spans = spans.select("doc_id", (F.col("begin") + F.col("start")).alias("start"), (F.col("begin") + F.col("end")).alias("end")).distinct()
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(w)
    return spans.withColumn("before", before).withColumn("island", island).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def shared(documents: DataFrame) -> DataFrame:
    """Per document its n_chars, shared_chars and shared (from 0 to 1): how much of its text stands in spans of other documents; 0 for null and empty texts."""
    got = passages(documents).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
    sizes = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    both = sizes.join(got, "doc_id", "left").fillna(0, ["shared_chars"])
    return both.select("doc_id", "n_chars", "shared_chars", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0).alias("shared"))
