"""Token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

A file holds the ids of whole documents in order, as places in its own table of ids by frequency. Ids are cut into blocks of
BLOCK; each starts from the same fresh state and has a byte length and a crc32 in the directory. The blocks of a file are
coded side by side, a lane each, so that one step of the model is a few dozen numpy operations over all lanes.

A lane's order-2 and order-1 tables predict the next id from the last two and the last one, each entry with a confidence.
Three adaptive estimates that the predicted id is right - by the order-2 entry's confidence, by the order-1 entry's, and
the lane's own rate - are mixed logistically with weights that learn from every id. The range coder codes whether the
prediction holds, and if not the id itself by the order-0 frequencies, which the file carries. All arithmetic is on
integers, so that any machine decodes what any other wrote.

Format, little-endian: MAGIC; u32 sizes of the compressed head and the directory; the head (zlib): i64 partition, i64 number of
the file in it, i64 documents, i64 table entries, then per document i64 id, u8 whether the id is null, i64 ids, and per table
entry u32 id, u32 frequency; the directory: per block u32 ids, u32 16-bit words, u32 crc32 of the ids as u32; the words; a
newline, the writer's line separator.

Defined cases: a null or empty text has only the end id; a null doc_id comes first; equal doc_ids keep some order; a document of
any length stays in one file; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from decimal import Decimal, localcontext
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import REMEMBER, TextEncoder, slices, tokenizer_path
from .common import materialize, scratch, small, table

MAGIC = b"LDTOK1\r\n"
BLOCK = 2048  # ids
LANES = 2048  # blocks side by side
FILE_IDS = BLOCK * LANES
ORDER0, ORDER1, ORDER2 = 1 << 10, 1 << 10, 1 << 11  # entries a lane
TOTAL = 20  # bits of the order-0 frequencies' sum
END_ID = 2

_U = np.uint64
_TOP, _BOT = _U(1 << 48), _U(1 << 40)  # what a flag and an id leave of the range is 1 << 4 at least


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """stretch (of 12 bits, in 1/256) and squash (of -2047..2047, to 12 bits), by decimal arithmetic: the same anywhere."""
    with localcontext() as c:
        c.prec = 20
        stretch = [int((256 * (Decimal(p) / (4096 - p)).ln()).to_integral_value()) for p in range(1, 4096)]
        squash = [int((4096 / (1 + (Decimal(-d) / 256).exp())).to_integral_value()) for d in range(-2047, 2048)]
    return np.array([stretch[0], *stretch], np.int32).clip(-2047, 2047), np.array(squash, np.int32).clip(16, 4080)


class Model:
    """The predictions of n lanes; predict() and update() are called in turn for each id of every lane."""

    def __init__(self, n: int):
        # a row an order: what is alike for several is one numpy operation
        lanes = np.arange(n, dtype=np.int64)
        self.base0, self.base = lanes * ORDER0, np.stack([lanes * ORDER1, n * ORDER1 + lanes * ORDER2])
        self.t0 = np.zeros(n * ORDER0, np.int8)  # how often the lane had an id, by its lower bits
        self.t = np.zeros(n * (ORDER1 + ORDER2), np.int32)  # of orders 1 and 2: confidence << 20 | place + 1
        self.lane8 = np.stack([lanes * 8 + r * 8 * n for r in range(3)])
        self.e = np.repeat(np.array([1024, 1024, 2048], np.int32), n * 8)
        self.w = np.repeat(np.array([[12000], [24000], [24000]], np.int32), n, axis=1)
        self.p1, self.p2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.i, self.j = np.zeros((2, n), np.int64), np.zeros((3, n), np.int64)
        self.stretch, self.squash = _tables()

    def narrow(self, n: int) -> None:
        """Goes on with the first n lanes."""
        for name in ("base0", "base", "lane8", "w", "p1", "p2", "i", "j"):
            setattr(self, name, getattr(self, name)[..., :n])

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """(predicted place + 1 or 0, probability of it in 16 bits)."""
        i, j = self.i, self.j
        np.bitwise_and(self.p1, ORDER1 - 1, out=i[0])
        np.bitwise_and(self.p2 * 1327 + self.p1 * 31, ORDER2 - 1, out=i[1])
        i += self.base
        self.s = self.t.take(i)  # take() is faster than an index
        self.c, self.k = c, k = self.s & 0xFFFFF, self.s >> 20
        self.guess = np.where((k[1] > 0) | (c[0] == 0), c[1], c[0])
        j[0] = self.t0.take(self.base0 + (self.guess & (ORDER0 - 1)))
        np.add(k << 1, c[0] == c[1], out=j[1:])
        j += self.lane8
        self.q = self.e.take(j)
        self.x = self.stretch.take(self.q)
        dot = self.w * self.x
        self.p = self.squash.take(((dot[0] + dot[1] + dot[2]) >> 15) + 2047, mode="clip")
        return self.guess, self.p << 4

    def update(self, place: np.ndarray, hit: np.ndarray) -> None:
        target = hit.astype(np.int32) << 12
        step = self.x * ((target - self.p) * 10)
        step >>= 12
        w = self.w
        w += step
        np.minimum(w, 1 << 17, out=w)  # so that three products fit 31 bits
        np.maximum(w, -(1 << 17), out=w)
        # shifts round down, so that estimates stay within 15 of either end
        np.subtract(target, self.q, out=step)
        step >>= 4
        step += self.q
        self.e[self.j] = np.minimum(step, 4095, out=step)
        new = (place + 1).astype(np.int32)
        i0 = self.base0 + (new & (ORDER0 - 1))
        self.t0[i0] = np.minimum(self.t0.take(i0) + 1, 7)
        # right: surer, up to 3; wrong: less sure, replaced when not sure at all
        right = np.minimum(self.s + (1 << 20), 3 << 20 | self.c)
        self.t[self.i] = np.where(self.c == new, right, np.where(self.k > 1, self.s - (2 << 20), new))
        self.p2, self.p1 = self.p1, place


class Coder:
    """A range coder of n lanes: low and range of 64 bits, 16-bit words out as the top settles, the range cut where it straddles."""

    def __init__(self, n: int):
        self.low, self.range = np.zeros(n, _U), np.full(n, (1 << 64) - 1, _U)

    def narrow(self, n: int) -> None:
        self.low, self.range = self.low[:n], self.range[:n]

    def flag(self, hit: np.ndarray, share: np.ndarray) -> None:
        """Codes hits; share is what of the range a hit takes."""
        self.low += np.where(hit, _U(0), share)
        self.range = np.where(hit, share, self.range - share)

    def symbol(self, at: np.ndarray, start: np.ndarray, freq: np.ndarray, r: np.ndarray) -> None:
        self.low[at] = self.low.take(at) + r * start
        self.range[at] = r * freq

    def settled(self):
        """Rounds of (lanes, their upper words) to shift out."""
        low, rng = self.low, self.range
        todo = np.flatnonzero(((low ^ (low + rng)) < _TOP) | (rng < _BOT))
        while len(todo):
            a, b = low.take(todo), rng.take(todo)
            cut = np.flatnonzero((a ^ (a + b)) >= _TOP)  # straddles, which is rare: the range is cut so that the top is settled
            if len(cut):
                b[cut] = (~a[cut] + _U(1)) & (_BOT - _U(1))
                b[b == 0] = _BOT
            yield todo, a >> _U(48)
            a, b = a << _U(16), b << _U(16)
            low[todo], rng[todo] = a, b
            todo = todo[((a ^ (a + b)) < _TOP) | (b < _BOT)]


class Encoder(Coder):
    def __init__(self, n: int, most: int):
        super().__init__(n)
        self.out, self.first = np.zeros(n * most, np.uint16), np.arange(n, dtype=np.int64) * most
        self.at = self.first.copy()

    def shift(self) -> None:
        for lanes, words in self.settled():
            at = self.at.take(lanes)
            self.out[at] = words
            self.at[lanes] = at + 1

    def finish(self) -> None:
        for _ in range(4):
            self.out[self.at[: len(self.low)]] = self.low >> _U(48)
            self.at[: len(self.low)] += 1
            self.low = self.low << _U(16)

    def words(self, lane: int) -> np.ndarray:
        return self.out[self.first[lane] : self.at[lane]]


class Decoder(Coder):
    def __init__(self, words: np.ndarray, starts: np.ndarray):
        super().__init__(len(starts))
        self.words, self.at = words, starts.copy()
        self.value = np.zeros(len(starts), _U)
        for _ in range(4):
            self.value = self.value << _U(16) | self.words[self.at]
            self.at += 1

    def narrow(self, n: int) -> None:
        super().narrow(n)
        self.value = self.value[:n]

    def places(self, at: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Which of the 1 << TOTAL parts of width r the value is in: a quotient of doubles, put right by its remainder."""
        off = self.value.take(at) - self.low.take(at)
        got = np.minimum((off / r).astype(_U), _U((1 << TOTAL) - 1))
        rest = off - got * r
        got -= rest >> _U(63)
        return np.minimum(got + ((rest >= r) & (rest < _U(1 << 63))), _U((1 << TOTAL) - 1))

    def shift(self) -> None:
        for lanes, _ in self.settled():
            at = self.at.take(lanes)
            self.value[lanes] = self.value.take(lanes) << _U(16) | self.words.take(at)
            self.at[lanes] = at + 1


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 1 << TOTAL, each 1 at least."""
    room = (1 << TOTAL) - len(counts)
    if room < 0:
        raise ValueError(f"{len(counts)} different ids; a file holds {1 << TOTAL} at most")
    f = 1 + counts.astype(np.int64) * room // max(1, int(counts.sum()))
    if len(f):
        f[0] += (1 << TOTAL) - int(f.sum())
    return f


def encode_lanes(places: np.ndarray, freq: np.ndarray) -> list[np.ndarray]:
    """Up to LANES blocks of places -> each block's 16-bit words."""
    n = -(-len(places) // BLOCK)
    grid = np.zeros(n * BLOCK, np.int32)
    grid[: len(places)] = places
    steps = np.ascontiguousarray(grid.reshape(n, BLOCK).T)
    last = len(places) - (n - 1) * BLOCK
    start = (np.cumsum(freq) - freq).astype(_U)
    freq = freq.astype(_U)
    model, coder = Model(n), Encoder(n, BLOCK * 3 + 16)
    width = n
    for t in range(BLOCK if n > 1 else last):
        if t == last and n > 1:
            width = n - 1
            model.narrow(width)
            rest = coder.low[width:], coder.range[width:]
            coder.narrow(width)
        place = steps[t, :width].astype(np.int64)
        guess, p = model.predict()
        hit = guess == place + 1
        coder.flag(hit, (coder.range >> _U(16)) * p.astype(_U))
        miss = np.flatnonzero(~hit)
        if len(miss):
            own = place.take(miss)
            coder.symbol(miss, start.take(own), freq.take(own), coder.range.take(miss) >> _U(TOTAL))
        coder.shift()
        model.update(place, hit)
    if width < n:
        coder.low, coder.range = np.concatenate([coder.low, rest[0]]), np.concatenate([coder.range, rest[1]])
    coder.finish()
    return [coder.words(i) for i in range(n)]


def decode_lanes(words: np.ndarray, starts: np.ndarray, count: int, freq: np.ndarray) -> np.ndarray:
    """The places of blocks whose words begin at starts: count of them in all."""
    n = len(starts)
    last = count - (n - 1) * BLOCK
    ends = np.cumsum(freq).astype(_U)
    freq = freq.astype(_U)
    start = ends - freq
    out = np.zeros((BLOCK, n), np.int32)
    model, coder = Model(n), Decoder(np.concatenate([words, np.zeros(8, np.uint16)]), starts)
    # the first place whose share of the sum reaches past a target, by a table of its upper bits
    coarse = np.searchsorted(ends, np.arange(1 << 14, dtype=_U) << _U(TOTAL - 14), "right")
    single = np.append(coarse[1:], len(freq) - 1) == coarse
    width = n
    for t in range(BLOCK if n > 1 else last):
        if t == last and n > 1:
            width = n - 1
            model.narrow(width)
            coder.narrow(width)
        guess, p = model.predict()
        share = (coder.range >> _U(16)) * p.astype(_U)
        hit = coder.value - coder.low < share
        coder.flag(hit, share)
        place = guess.astype(np.int64) - 1
        miss = np.flatnonzero(~hit)
        if len(miss):
            r = coder.range.take(miss) >> _U(TOTAL)
            got = coder.places(miss, r)
            upper = (got >> _U(TOTAL - 14)).astype(np.int64)
            found = coarse.take(upper)
            hard = np.flatnonzero(~single.take(upper))
            if len(hard):
                found[hard] = np.searchsorted(ends, got[hard], "right")
            place[miss] = found
            coder.symbol(miss, start.take(found), freq.take(found), r)
        coder.shift()
        out[t, :width] = place
        model.update(place, hit)
    return out.T.reshape(-1)[:count] if n > 1 else out[:count, 0]


def encode_file(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, partition: int, number: int) -> bytes:
    """A file of these documents."""
    if len(ids) and int(ids.max()) < 1 << 22:  # counted in a table rather than by a sort
        table_ = np.bincount(ids)
        used = np.flatnonzero(table_).astype(np.uint32)
        counts, inverse = table_[used], None
    else:
        used, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((used, -counts))
    rank = np.empty(len(used), np.int64)
    rank[order] = np.arange(len(used))
    if inverse is None:
        places = np.zeros(len(table_), np.int64)
        places[used] = rank
        places = places[ids]
    else:
        places = rank[inverse]
    freq = frequencies(counts[order])
    head = struct.pack("<4q", partition, number, len(doc_ids), len(used)) + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + sizes.astype("<i8").tobytes() + used[order].astype("<u4").tobytes() + freq.astype("<u4").tobytes()
    directory, words = [], []
    for a in range(0, len(ids), FILE_IDS):
        for k, w in enumerate(encode_lanes(places[a : a + FILE_IDS], freq)):
            own = ids[a + k * BLOCK : min(a + (k + 1) * BLOCK, a + FILE_IDS, len(ids))].astype("<u4")
            directory.append((len(own), len(w), zlib.crc32(own.tobytes())))
            words.append(w.astype("<u2").tobytes())
    packed, listed = zlib.compress(head, 6), np.array(directory, "<u4").tobytes()
    return MAGIC + struct.pack("<2I", len(packed), len(listed)) + packed + listed + b"".join(words)


def decode_file(data: bytes) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    """(partition, number, doc_ids, sizes, ids) of a file; every block is checked."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    at = len(MAGIC) + 8
    packed, listed = struct.unpack_from("<2I", data, len(MAGIC))
    head = zlib.decompress(data[at : at + packed])
    partition, number, docs, entries = struct.unpack_from("<4q", head)
    p = 32
    names = np.frombuffer(head, "<i8", docs, p)
    nulls = np.frombuffer(head, "u1", docs, p + 8 * docs)
    sizes = np.frombuffer(head, "<i8", docs, p + 9 * docs)
    used = np.frombuffer(head, "<u4", entries, p + 17 * docs)
    freq = np.frombuffer(head, "<u4", entries, p + 17 * docs + 4 * entries).astype(np.int64)
    directory = np.frombuffer(data, "<u4", listed // 4, at + packed).reshape(-1, 3).astype(np.int64)
    words = np.frombuffer(data, "<u2", int(directory[:, 1].sum()), at + packed + listed)
    starts = np.cumsum(directory[:, 1]) - directory[:, 1]
    out = []
    for a in range(0, len(directory), LANES):
        part = directory[a : a + LANES]
        own = words[starts[a] : starts[a] + part[:, 1].sum()]
        ids = used[decode_lanes(own, starts[a : a + LANES] - starts[a], int(part[:, 0].sum()), freq)]
        edge = np.concatenate([[0], np.cumsum(part[:, 0])])
        for k, crc in enumerate(part[:, 2].tolist()):
            if zlib.crc32(ids[edge[k] : edge[k + 1]].astype("<u4").tobytes()) != crc:
                raise ValueError(f"block {a + k} of file {partition}.{number} is damaged")
        out.append(ids)
    return partition, number, [None if z else int(d) for d, z in zip(names, nulls)], sizes, np.concatenate(out) if out else np.empty(0, np.uint32)


_OPEN: dict[str, TextEncoder] = {}
#: A plain run: letters whose case and composition no normalisation splits, then marks, which are one pre-token together.
PLAIN_RUN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"


def library_encoder(path: str) -> TextEncoder:
    """Whole texts by the tokenizers library, a distinct white-space run once (the file's pre-tokens never span white space).

    Most runs are a plain word with or without marks after it. Of these each distinct lower-cased word and each string of marks
    goes to the library once: words, many a call, by the file's own model with a split at spaces alone, as all else that the
    file's normaliser and split do is done. Other runs go to the file's tokenizer as they are.
    """
    if path not in _OPEN:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        special = {t.content: i for i, t in own.get_added_tokens_decoder().items()}
        mark, mark_id = next(iter(special.items()), (None, None))
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_level = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel"]
        bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *byte_level]}}))

        ends = np.zeros(own.get_vocab_size(), bool)  # ids that end a pre-token
        for t, i in own.get_vocab().items():
            ends[i] = t.endswith("</w>")
        known: dict[str, bytes] = {}
        encode = lambda by, text: np.array(by.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

        def cut(ids: np.ndarray, cuts: np.ndarray, gap: int) -> list[bytes]:
            raw, starts = ids.tobytes(), np.concatenate([[0], cuts[:-1] + gap])
            return [raw[x:y] for x, y in zip((4 * starts).tolist(), (4 * cuts).tolist())]

        def learn(words: list[str]) -> None:
            if len(known) > REMEMBER:
                known.clear()
            new = [w for w in words if w not in known]
            for a in range(0, len(new), 500):
                some = new[a : a + 500]
                ids = encode(bare, " ".join(some))
                known.update(zip(some, cut(ids, np.flatnonzero(ends[ids]) + 1, 0)))

        def runs(texts: list[str]) -> list[bytes]:
            parts = pc.extract_regex(pa.array(texts, pa.large_string()), PLAIN_RUN)
            plain = np.flatnonzero(pc.is_valid(parts).to_numpy(zero_copy_only=False))
            words = pc.utf8_lower(parts.field("word")).take(pa.array(plain)).dictionary_encode()
            marks = parts.field("marks").take(pa.array(plain)).dictionary_encode()
            listed = lambda x: x.to_numpy(zero_copy_only=False).tolist()
            distinct = listed(words.dictionary)
            learn(distinct)
            of_words = [known[w] for w in distinct]
            of_marks = [encode(own, m).tobytes() if m else b"" for m in listed(marks.dictionary)]
            out: list[bytes] = [b""] * len(texts)
            for k, w, m in zip(plain.tolist(), listed(words.indices), listed(marks.indices)):
                out[k] = of_words[w] + of_marks[m]
            rest = np.ones(len(texts), bool)
            rest[plain] = False
            # the others are told apart by a special token between them; those that hold its text go alone
            rest = np.flatnonzero(rest).tolist()
            other = [k for k in rest if mark is not None and mark not in texts[k]]
            for a in range(0, len(other), 2000):
                some = other[a : a + 2000]
                ids = encode(own, mark.join([texts[k] for k in some]))
                for k, got in zip(some, cut(ids, np.append(np.flatnonzero(ids == mark_id), len(ids)), 1)):
                    out[k] = got
            for k in {*rest} - {*other}:
                out[k] = np.array(own.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes()
            return out

        _OPEN[path] = TextEncoder(runs)
    return _OPEN[path]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes docs in ascending order of id_col into files under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, partition = library_encoder(tokenizer), TaskContext.get().partitionId()
        names: list = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = number = 0
        close = lambda: pa.RecordBatch.from_arrays([pa.array([encode_file(names, np.concatenate(sizes), np.concatenate(ids), partition, number)], pa.binary())], ["file"])
        for whole in batches:
            for batch in slices(whole, 1, 6 << 20):
                got, own = encoder(batch.column(1))
                ended = np.insert(got, np.cumsum(own), end_id).astype(np.uint32)
                names += batch.column(0).to_pylist()
                sizes.append(own + 1)
                ids.append(ended)
                held += len(ended)
                if held >= FILE_IDS * 15 // 16:
                    yield close()
                    names, sizes, ids, held, number = [], [], [], 0, number + 1
        if names:
            yield close()

    ordered = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).repartitionByRange(id_col).sortWithinPartitions(id_col)
    # a cell's bytes as a string, which no expression looks at: the text writer puts them out as they are, under Spark's commit protocol
    files = ordered.mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The files' documents: doc_id, part and number of the file, local (ids before it in the file), n_tokens, ids_crc32, ids (or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                part, number, names, sizes, ids = decode_file(data.as_py())
                ends = np.cumsum(sizes)
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                crcs = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist())]
                step = 4096 if not with_ids else 256
                for a in range(0, len(names), step):
                    b = min(a + step, len(names))
                    n = b - a
                    offsets = np.concatenate([[0], ends[a:b] - (ends[a - 1] if a else 0)]).astype(np.int32)
                    own = pa.ListArray.from_arrays(offsets, pa.array(ids[ends[a] - sizes[a] : ends[b - 1]].astype(np.int64))) if with_ids else pa.nulls(n, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(names[a:b], pa.int64()), pa.array([part] * n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array(ends[a:b] - sizes[a:b]), pa.array(sizes[a:b]), pa.array(crcs[a:b], pa.int64()), own], ["doc_id", "part", "number", "local", "n_tokens", "ids_crc32", "ids"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "doc_id long, part long, number long, local long, n_tokens long, ids_crc32 long, ids array<long>")


def placed(found: DataFrame) -> DataFrame:
    """read()'s rows with start, the ids of all documents before it. The running sum is over one row a file."""
    totals = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = small(materialize(totals.select("part", "number", before.alias("before")), "token-files"))
    return found.join(files, ["part", "number"]).withColumn("start", F.col("before") + F.col("local"))


def op2_tokens(spark, sf_dir):
    path = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    found = materialize(read(spark, path, with_ids=False).drop("ids"), "token-docs")
    return placed(found).select("doc_id", "start", "n_tokens", "ids_crc32")
