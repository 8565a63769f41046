"""Removal of repeated byte strings by suffix buckets that are refined in place of a full suffix array.

A string of LENGTH bytes that starts at two places is a repeat; each byte it covers goes, in all its places. Suffixes are
sorted into buckets only where that can matter, and only as deep as LENGTH:

1. Sampled suffixes. Of the LENGTH-byte window at each start, the anchor is the place with the smallest hash of GRAM bytes
   (leftmost on ties of its first 24 bits). Anchors depend on the window alone, so equal windows have equal anchors at equal
   offsets, and each anchor owns a run of starts. The initial buckets hold the anchors by their q-gram (q = GRAM). A bucket
   with one suffix is final: its starts are no repeats. Suffixes that agree on all windows they own are one with a count.
2. Refinement. In the buckets that are still open, the starts of a suffix are a range of offsets to the anchor. The core of
   a range is what all its windows share; the initial core is the q-gram itself. A round cuts each open range into parts
   (STEPS), whose cores reach further, and sorts the parts on (bucket identifier of the core so far, identifiers of the
   strings at the offsets that the core gains on either side). That gives the bucket identifier of the longer core, which the
   next round uses in its turn. A part whose new bucket holds no other suffix is final, without repeats; one whose bucket
   agrees on all that its windows cover is final, all repeats; only the rest stays open. At the last step a part is one start.
3. The settled starts of each text become spans, which are cut out of the text.

So work follows the edges of repeats and not their length, and never the pairs of a bucket. Equal texts share one key (their
digest). Buckets are Spark groups that are pre-aggregated before the shuffle, and what is joined to them comes from a written
table, so that adaptive execution can split a hot bucket; no bucket of more than MOST suffixes is collected in one task.
Identifiers are 64-bit hashes within the bucket of another 64-bit hash.

Cases: null is empty; texts shorter than LENGTH bytes are kept whole; repeated rows and equal ids are rows of their own;
columns of any other name stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, byte_codes, fresh, prefix_hash, signed, sliding_min, span_hash, span_order, table, text_chunks, through_disk

LENGTH, GRAM, STEPS = 400, 200, (64, 8, 1)
#: Suffixes of a bucket that one task refines.
MOST = 256
#: Bytes that a kernel works on at a time, so that its arrays stay in a core's cache; a longer text or bucket makes a piece of its own.
PIECE = 1 << 16
#: Bits of an anchor's place in its chunk; the hash keeps the rest, whatever the chunk's size.
_PLACE = 40


def _key(text):
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def anchors(texts: DataFrame, length: int, gram: int, rows: bool = True) -> DataFrame:
    """texts: key, text (binary). A row per anchor: its bucket h, the identifier of all its windows, its starts (it - t_hi to it - t_lo), key and place. rows: if false, h alone."""
    width, kinds = length - gram + 1, (np.int64, np.int64, np.int32, np.int32, np.int64, np.int32)

    def found(batch):
        for a, _, data, offsets in text_chunks(batch, "text", PIECE):
            if len(data) < length:
                continue
            sums, n = prefix_hash(byte_codes(data)), len(data)
            at = np.arange(n - gram + 1)
            doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
            bits = np.uint64((1 << _PLACE) - 1)
            order = (span_order(sums, gram) & ~bits) | at.astype(np.uint64)  # ties go to the left
            order[doc[: n - gram + 1] != doc[gram - 1 :]] |= ~bits
            starts = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
            if not len(starts):
                continue
            place = (sliding_min(order, width)[starts] & bits).astype(np.int64)
            turn = np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]
            low = starts[turn]
            high = starts[np.r_[np.flatnonzero(turn)[1:] - 1, len(starts) - 1]]
            it = place[turn]
            own = doc[it]
            h = signed(span_hash(sums, it, it + gram))
            yield (h, signed(span_hash(sums, low, high + length)), it - high, it - low, a + own, it - offsets[own]) if rows else (h,)

    def run(batches):
        for batch in batches:
            pieces = found(batch)
            while made := list(islice(pieces, 64)):
                columns = [pa.array(np.concatenate(x).astype(kind, copy=False)) for x, kind in zip(zip(*made, strict=True), kinds, strict=False)]
                if rows:
                    columns[4] = batch.column("key").take(columns[4])
                yield pa.RecordBatch.from_arrays(columns, ["h", "whole", "t_lo", "t_hi", "key", "place"][: len(columns)])

    return texts.mapInArrow(run, "h long, whole long, t_lo int, t_hi int, key binary, place int" if rows else "h long")


SUFFIX = {"h": "long", "id": "long", "n": "long", "size": "long", "t_lo": "int", "t_hi": "int", "place": "int"}


def _contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted suffixes (SUFFIX and key) with the bytes of all their windows. Copies of a text may give a suffix again, under its id."""
    lists = through_disk(wanted.groupBy("key").agg(F.collect_list(F.struct(*SUFFIX)).alias("wanted")))  # of one text: no more than its anchors

    def run(batches):
        before = None
        for batch in batches:
            keys, lists, texts = batch.column("key"), batch.column("wanted"), batch.column("text").cast(pa.large_binary())
            of, rows = lists.value_parent_indices().to_numpy(), lists.flatten()
            names = keys.to_pylist()
            new = np.array([x != y for x, y in zip(names, [before, *names], strict=False)])  # no copy of the text before
            before = names[-1] if names else before
            offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
            data = memoryview(texts.buffers()[2] or b"")
            lo, hi, place = (rows.field(x).to_numpy() for x in ("t_lo", "t_hi", "place"))
            begin, size = offsets[of] + place - hi, hi - lo + length
            chosen = np.flatnonzero(new[of])
            for at in range(0, len(chosen), 4096):
                part = chosen[at : at + 4096]
                context = b"".join([data[x : x + n] for x, n in zip(begin[part].tolist(), size[part].tolist(), strict=True)])
                ends = np.r_[0, np.cumsum(size[part])].astype(np.int32)
                taken = rows.take(pa.array(part))
                columns = [*(taken.field(x) for x in SUFFIX), keys.take(pa.array(of[part])), pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(context)])]
                yield pa.RecordBatch.from_arrays(columns, [*SUFFIX, "key", "context"])

    return texts.join(lists, "key").mapInArrow(run, ", ".join(f"{x} {kind}" for x, kind in SUFFIX.items()) + ", key binary, context binary")


def _cut(sums, zero, lo, hi, length: int, gram: int, before: int | None, step: int) -> tuple[np.ndarray, ...]:
    """Open ranges (offsets lo to hi of the suffix at zero) cut into parts of step starts: the range, r, low and high of each part, and the identifiers of what the core gains on the left and on the right, and of what all windows of the part cover. before: the step of the open ranges; None at first, when the core is the gram."""
    first = lo // step
    many = hi // step - first + 1
    c = np.repeat(np.arange(len(lo)), many)
    r = np.arange(len(c)) - np.repeat(np.cumsum(many) - many, many) + first[c]
    low, high, zero = np.maximum(lo[c], r * step), np.minimum(hi[c], r * step + step - 1), zero[c]
    reach = lambda r, step: np.minimum(r * step + step - 1, length - gram)  # noqa: E731  no window stands further from its anchor
    left, right = zero - r * step, zero - reach(r, step) + length  # the core
    if before is None:
        known_left, known_right = zero, zero + gram
    else:
        up = r * step // before
        known_left, known_right = zero - up * before, zero - reach(up, before) + length
    whole = span_hash(sums, zero - high, zero - low + length) ^ (low * 1024 + high).astype(np.uint64)
    return c, r, low, high, span_hash(sums, left, known_left), span_hash(sums, known_right, right), whole


def _rounds(data, zero, bucket, ids, lo, hi, length: int, gram: int, steps) -> tuple[np.ndarray, ...]:
    """All rounds on whole buckets: of the starts that are repeats, the suffix (by its row) and the offsets low and high, adjacent ones as one."""
    sums, own, before, found = prefix_hash(byte_codes(data)), np.arange(len(ids)), None, []
    for step in steps:
        c, r, low, high, left, right, whole = _cut(sums, zero[own], lo, hi, length, gram, before, step)
        place = [bucket[c], r, left, right]
        order = np.argsort(sum(x.astype(np.uint64) * np.uint64(odd) for x, odd in zip(place, _ODD, strict=True)))
        place = [x[order] for x in place]
        turn = np.r_[True, np.any([x[1:] != x[:-1] for x in place], axis=0)]
        own, low, high, whole, edges, group = own[c][order], low[order], high[order], whole[order], np.flatnonzero(turn), np.cumsum(turn) - 1
        shared = np.minimum.reduceat(ids[own], edges) < np.maximum.reduceat(ids[own], edges)
        agree = np.minimum.reduceat(whole, edges) == np.maximum.reduceat(whole, edges)
        final = (shared & (agree | (step == 1)))[group]
        found.append((own[final], low[final], high[final]))
        rest = shared[group] & ~final
        if not rest.any():
            break
        own, lo, hi, bucket, before = own[rest], low[rest], high[rest], group[rest], step
    own, low, high = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((low, own))
    own, low, high = own[order], low[order], high[order]
    turn = np.r_[True, (own[1:] != own[:-1]) | (low[1:] != high[:-1] + 1)][: len(own)]
    return own[turn], low[turn], high[np.r_[turn[1:], True][: len(own)]]


_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h and id, each once, cut only between buckets."""
    held, last = [], None

    def joined():
        return pa.Table.from_batches(held).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1]))  # where the last bucket begins
        if held and (cut or h[0] != last):
            held.append(batch.slice(0, cut))
            yield from joined()
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
        last = h[-1]
    if held:
        yield from joined()


def refine_buckets(contexts: DataFrame, length: int, gram: int, steps, most: int) -> DataFrame:
    """contexts: SUFFIX, key and context; size: suffixes of the bucket. Whole buckets of up to most suffixes are refined in a task: rows (key, start, stop) of repeats. The suffixes of larger ones come back as they are, each once, with start and stop null."""
    names = [*SUFFIX, "key", "context"]

    def pieces(batch):
        """Rows of small buckets, some PIECE bytes at a time."""
        h, context = batch.column("h").to_numpy(), batch.column("context").cast(pa.large_binary())
        data, offsets = np.frombuffer(context.buffers()[2], np.uint8), np.frombuffer(context.buffers()[1], np.int64, len(context) + 1, context.offset * 8)
        turns, at = np.r_[np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)], 0
        while at < len(h):
            fit = np.searchsorted(offsets[turns], offsets[at] + PIECE, "right")
            to = turns[max(int(fit) - 1, int(np.searchsorted(turns, at, "right")))]
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at:to] - offsets[at]
            at = int(to)

    def run(batches):
        for batch in _whole_buckets(batches):
            h, ids = batch.column("h").to_numpy(), batch.column("id").to_numpy()
            batch = batch.filter(pa.array(np.r_[True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])]))
            large = batch.column("size").to_numpy() > most
            if large.any():
                open_ = batch.filter(pa.array(large))
                yield pa.RecordBatch.from_arrays([*open_.columns, *[pa.nulls(open_.num_rows, pa.int32())] * 2], [*names, "start", "stop"])
                batch = batch.filter(pa.array(~large))
            for piece, data, begin in pieces(batch) if batch.num_rows else ():
                bucket, ids, n, lo, hi, place = (piece.column(x).to_numpy() for x in ("h", "id", "n", "t_lo", "t_hi", "place"))
                own, low, high = _rounds(data, begin + hi, bucket, ids, lo, hi, length, gram, steps)
                once = n[own] == 1  # the others are settled
                own, low, high = own[once], low[once], high[once]
                empty = {x: pa.nulls(len(own), piece.schema.field(x).type) for x in names}
                span = [pa.array(x.astype(np.int32)) for x in (place[own] - high, place[own] - low + length)]
                yield pa.RecordBatch.from_arrays([*(empty | {"key": piece.column("key").take(pa.array(own))}).values(), *span], [*names, "start", "stop"])

    together = F.when(F.col("size") <= most, F.col("h")).otherwise(F.col("id"))
    return contexts.repartition(together).sortWithinPartitions("h", "id").mapInArrow(run, ", ".join(f"{x} {kind}" for x, kind in SUFFIX.items()) + ", key binary, context binary, start int, stop int")


def _parts(ranges: DataFrame, length: int, gram: int, before: int | None, step: int) -> DataFrame:
    """Open ranges (id, bucket, low, high, t_hi, context) cut into parts of step starts, as _cut() does."""

    def run(batches):
        for batch in batches:
            bucket, ids, lo, hi, top = (batch.column(x).to_numpy() for x in ("bucket", "id", "low", "high", "t_hi"))
            for a, z, data, offsets in text_chunks(batch, "context"):
                c, r, low, high, left, right, whole = _cut(prefix_hash(byte_codes(data)), offsets[:-1] + top[a:z], lo[a:z], hi[a:z], length, gram, before, step)
                columns = [pa.array(bucket[a:z][c]), pa.array(r.astype(np.int32)), pa.array(signed(left)), pa.array(signed(right)), pa.array(signed(whole)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(ids[a:z][c])]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "r", "left", "right", "whole", "low", "high", "id"])

    return ranges.select("bucket", "id", "low", "high", "t_hi", "context").mapInArrow(run, "bucket long, r int, left long, right long, whole long, low int, high int, id long")


def refine(contexts: DataFrame, length: int, gram: int, steps=STEPS) -> DataFrame:
    """contexts: id, bucket, t_lo, t_hi, context. Rows (id, low, high): offsets of starts that are repeats."""
    found, before = [], None
    ranges = contexts.withColumns({"low": F.col("t_lo"), "high": F.col("t_hi")})
    for step in steps:
        parts = through_disk(_parts(ranges, length, gram, before, step))
        place = ["bucket", "r", "left", "right"]
        # the same suffix can stand here again, so other suffixes show by their ids and not by the number of rows
        shared = parts.groupBy(*place).agg(F.min("id").alias("a"), F.max("id").alias("z"), F.min("whole").alias("least"), F.max("whole").alias("most")).where("a < z")
        shared = through_disk(shared.select(*place, F.xxhash64(*place).alias("finer"), (F.col("least") == F.col("most")).alias("agree")))
        alive = parts.join(shared, place).select("id", F.col("finer").alias("bucket"), "low", "high", "agree")
        if step == 1:
            found.append(alive.select("id", "low", "high"))
            break
        alive = through_disk(alive)
        found.append(alive.where("agree").select("id", "low", "high"))
        ranges = alive.where("NOT agree").select("id", "bucket", "low", "high").join(contexts.select("id", "t_hi", "context"), "id")
        before = step
    return reduce(DataFrame.union, found)


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, steps=STEPS, most: int = MOST) -> DataFrame:
    """texts: key (of equal texts), text (binary). key and spans: array of (start, stop), each a run of repeats' bytes, maybe overlapping."""
    shared = through_disk(anchors(texts, length, gram, rows=False).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    found = through_disk(anchors(texts, length, gram).join(shared, "h", "left_semi"))
    one = ["h", "whole", "t_lo", "t_hi"]
    classes = through_disk(found.groupBy(one).agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("first")).select(*one, "n", "first.*").withColumn("id", F.monotonically_increasing_id()))
    settled = found.join(classes.where("n > 1").select(one), one, "left_semi").select("key", (F.col("place") - F.col("t_hi")).alias("start"), (F.col("place") - F.col("t_lo") + length).alias("stop"))
    open_buckets = through_disk(classes.groupBy("h").agg(F.count("*").alias("size"), F.min("n").alias("least")).where("size > 1 AND least = 1").select("h", "size"))
    contexts = _contexts(texts, classes.join(open_buckets, "h"), length)
    refined = through_disk(refine_buckets(contexts, length, gram, steps, most))
    settled = settled.union(refined.where("start IS NOT NULL").select("key", "start", "stop"))
    if not open_buckets.where(F.col("size") > most).isEmpty():
        large = refined.where("start IS NULL")
        deep = refine(large.select("id", F.col("h").alias("bucket"), "t_lo", "t_hi", "context"), length, gram, steps)
        settled = settled.union(deep.join(large.where("n = 1").select("id", "key", "place"), "id").select("key", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + length).alias("stop")))
    return settled.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text", keep_text: bool = True, most: int = MOST) -> tuple[DataFrame, str]:
    """documents with a struct column (n_bytes, n_removed, n_spans, kept, kept_sha256), and its name; kept is null if keep_text is false."""
    key, spans, name = fresh(documents, "key"), fresh(documents, "spans"), fresh(documents, "repeats")
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = documents.select(payload.alias("text")).withColumn("key", _key(F.col("text"))).select("key", "text").where(F.octet_length("text") >= length)
    found = through_disk(repeated_spans(texts, length, gram, most=most)).select(F.col("key").alias(key), F.col("spans").alias(spans))
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def cut(batch: pa.RecordBatch) -> pa.Array:
        texts, of, rows = batch.column(text_col), batch.column(spans).value_parent_indices().to_numpy(), batch.column(spans).flatten()
        start, stop = (rows.field(x).to_numpy().astype(np.int64) for x in ("start", "stop"))
        base = of * (int(stop.max(initial=0)) + 1)  # one text after the other on a line
        order = np.argsort(base + start)
        of, base, start, stop = of[order], base[order], start[order], stop[order]
        end = np.maximum.accumulate(base + stop)
        turn = np.r_[True, (base + start)[1:] > end[:-1]][: len(of)]
        of, start, stop = of[turn], start[turn], (end - base)[np.r_[turn[1:], True][: len(of)]]
        many, removed = np.bincount(of, minlength=batch.num_rows), np.bincount(of, stop - start, batch.num_rows).astype(np.int64)
        runs, sizes, whole, digests = zip(start.tolist(), stop.tolist(), strict=True), [], [], []
        for i, n in enumerate(many.tolist()):
            text, kept, at = texts[i].as_buffer() if texts[i].is_valid else b"", [], 0
            for a, z in islice(runs, n):
                kept.append(text[at:a])
                at = z
            kept.append(text[at:])
            digest = hashlib.sha256()
            for x in kept:
                digest.update(x)
            sizes.append(len(text))
            whole.append(b"".join(map(bytes, kept)) if keep_text else None)
            digests.append(digest.hexdigest())
        columns = [sizes, removed, many, whole, digests]
        return pa.StructArray.from_arrays([pa.array(x, field.type) for x, field in zip(columns, kind, strict=True)], fields=list(kind))

    joined = documents.withColumn(key, _key(payload)).join(found, key, "left")
    return annotate(joined, cut, name, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary,kept_sha256:string>").drop(key, spans), name


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", f"{name}.n_bytes", f"{name}.n_removed", f"{name}.n_spans", f"{name}.kept_sha256")
