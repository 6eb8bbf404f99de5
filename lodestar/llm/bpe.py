"""BPE encoding and decoding: speculate and verify.

A text is cut into white-space runs and these into pre-tokens, as the tokenizer file says; each distinct pre-token is encoded
once a worker and remembered. For the new ones, greedy longest-match over the vocabulary proposes tokens. A proposal is right
if every token in it is what merging its own text gives, and every adjacent pair of tokens is compatible: merging the text
of the two together gives just the two again. (Merging acts on adjacent symbols by rank alone, so a merge across a border
of the final tokens would show in the two tokens beside that border.) The checks are looked up for all pairs of all words at
once, in an array of the pairs judged so far; only unjudged pairs are merged to be judged. Words that fail undergo exact
merging. Decoding joins the tokens' texts with spaces, as the file has no decoder.

Defined cases: a null or empty text has no ids and decodes to the empty text; long texts and words are encoded whole (exact
merging takes n log n for a word of n bytes); special tokens found in a text are encoded as their ids; repeated rows give
repeated results; an empty table gives an empty result. Added columns replace input columns of the same names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

END = "</w>"
#: Distinct white-space runs that a worker remembers; beyond, it forgets those that only one slice of text had.
REMEMBER = 400_000


def byte_letters() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own}
    return [letters.get(b) or chr(256 + [x for x in range(256) if x not in letters].index(b)) for b in range(256)]


class Tokenizer:
    """A word-end BPE tokenizer read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        self.ranks = {a << 32 | b: i for i, (a, b, _) in reversed(list(enumerate(ids)))}
        self.merged = [c for _, _, c in ids]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.text = [""] * size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.text[i] = t
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # Python's \\s also has U+001C-U+001F, the file's has the property alone
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.letters = dict(enumerate(byte_letters()))
        self.first_ids = {c: self.vocab.get(c) for c in self.letters.values()}
        self.last_ids = {c: self.vocab.get(c + END) for c in self.letters.values()}
        self.reach: dict[str, int] = {}  # longest token by its first four letters
        for t in self.vocab:
            self.reach[t[:4]] = max(len(t), self.reach.get(t[:4], 3))
        self.whole = np.full(size, -1, np.int8)  # is a token what merging its text gives? -1: not judged
        self.pair_keys, self.pair_fine = np.empty(0, np.int64), np.empty(0, bool)  # judged pairs, in order
        self.words: dict[str, bytes] = {}  # pre-token in byte letters -> ids, as little-endian unsigned 32-bit integers

    # --- exact merging

    def merge(self, ids: list[int]) -> list[int]:
        """The ids after all merges: lowest rank first, then leftmost."""
        if len(ids) > 64:
            return self.merge_long(ids)
        none, rank = len(self.merged), self.ranks.get
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i : i + 2] = [new] = [self.merged[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | new, none)
            if i < len(ranks):
                ranks[i] = rank(new << 32 | ids[i + 1], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """merge() with a heap, for long words."""
        n, rank = len(ids), self.ranks.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank(ids[i] << 32 | ids[j]) != r:
                continue  # merged meanwhile
            ids[i], ids[j] = self.merged[r], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [i for i in ids if i >= 0]

    def symbols(self, text: str) -> list[int]:
        """Ids of single letters, the word end kept with the last; letters without an id are left out."""
        ids = [*map(self.first_ids.get, text[: -len(END) - 1]), self.last_ids.get(text[-len(END) - 1])] if text.endswith(END) and len(text) > len(END) else [*map(self.first_ids.get, text)]
        return [i for i in ids if i is not None]

    def exact(self, word: str) -> list[int]:
        return self.merge(self.symbols(word + END))

    # --- speculation and its checks

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest matches over word and word end; None if some letter has no token."""
        text, out, at, get, reach = word + END, [], 0, self.vocab.get, self.reach.get
        last = len(word)
        while True:
            if (i := get(text[at:])) is not None:
                out.append(i)
                return out
            for end in range(min(last - 1, at + reach(text[at : at + 4], 3)), at, -1):
                if (i := get(text[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
            else:
                return None

    def judge_wholes(self, ids: np.ndarray) -> None:
        for i in np.unique(ids[self.whole[ids] < 0]).tolist():
            self.whole[i] = self.merge(self.symbols(self.text[i])) == [i]

    def judge_pairs(self, keys: np.ndarray) -> np.ndarray:
        """Of each key (left id << 32 | right id): does merging the two tokens' text give just the two?"""
        new = np.unique(keys)
        if len(self.pair_keys):
            at = np.minimum(np.searchsorted(self.pair_keys, new), len(self.pair_keys) - 1)
            new = new[self.pair_keys[at] != new]
        if len(new):
            fine = np.empty(len(new), bool)
            for k, key in enumerate(new.tolist()):
                a, b = key >> 32, key & 0xFFFFFFFF
                fine[k] = self.merge(self.symbols(self.text[a] + self.text[b])) == [a, b]
            keys_, fine_ = np.concatenate([self.pair_keys, new]), np.concatenate([self.pair_fine, fine])
            order = np.argsort(keys_)
            self.pair_keys, self.pair_fine = keys_[order], fine_[order]
        return self.pair_fine[np.searchsorted(self.pair_keys, keys)]

    def encode_words(self, words: list[str]) -> None:
        """Remembers the ids of pre-tokens (in byte letters) that are new."""
        proposed = [self.propose(w) for w in words]
        sizes = np.array([len(p) if p else 0 for p in proposed], np.int64)
        flat = np.array([i for p in proposed if p for i in p], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        right = sizes > 0
        if len(flat):
            self.judge_wholes(flat)
            right[owner[self.whole[flat] == 0]] = False
            inner = owner[1:] == owner[:-1]
            pair_owner = owner[1:][inner]
            keys = (flat[:-1][inner] << 32) | flat[1:][inner]
            right[pair_owner[~self.judge_pairs(keys)]] = False
        for w, p, fine in zip(words, proposed, right.tolist()):
            self.words[w] = array("I", p if fine else self.exact(w)).tobytes()

    # --- texts

    def pieces(self, run: str) -> list[str | int]:
        """A white-space run's pre-tokens in byte letters, and special tokens' ids."""
        if self.cut_special and "<|" in run:
            parts = self.cut_special(run)
        else:
            parts = [run]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                # lower case letter by letter: no rule for a final sigma
                low = part.lower() if part.isascii() else "".join([c.lower() for c in unicodedata.normalize("NFC", part)])
                out += [p if p.isascii() and p.isprintable() else "".join([self.letters[b] for b in p.encode()]) for p in self.split(low)]
        return out

    def encode_runs(self, runs: list[str]) -> list[bytes]:
        """The ids of white-space runs."""
        if len(self.words) > REMEMBER // 2:
            self.words = {}
        pieces = [self.pieces(r) for r in runs]
        new = {p for ps in pieces for p in ps if p.__class__ is str} - self.words.keys()
        if new:
            self.encode_words(list(new))
        get = self.words.__getitem__
        return [b"".join([get(p) if p.__class__ is str else array("I", [p]).tobytes() for p in ps]) for ps in pieces]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.text.__getitem__, ids.tolist()))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges that begin at starts, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class TextEncoder:
    """Encodes columns of whole texts, a distinct white-space run once: gathers ids instead of encoding again."""

    def __init__(self, encode_runs, remember: int = REMEMBER):
        self.encode_runs, self.remember = encode_runs, remember
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.sizes, self.seen = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def forget(self) -> None:
        """Keeps the runs seen in two slices or more; all go if most are such."""
        n = len(self.known)
        keep = np.flatnonzero(self.seen[:n] > 1)
        runs = list(self.known)
        starts, sizes, ids = self.starts[keep], self.sizes[keep], self.ids
        self.clear()
        if len(keep) > self.remember // 2:
            return
        self.put([runs[k] for k in keep.tolist()], ids[spread(starts, sizes)], sizes)

    def add(self, runs: list[str]) -> None:
        encoded = self.encode_runs(runs)
        self.put(runs, np.frombuffer(b"".join(encoded), "<u4"), np.fromiter(map(len, encoded), np.int64, len(runs)) >> 2)

    def put(self, runs: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, total = len(self.known), int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + len(runs) > len(self.starts):
            self.starts, self.sizes, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.seen))
        self.ids[self.used : self.used + total] = ids
        self.starts[n : n + len(runs)], self.sizes[n : n + len(runs)] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += total
        self.known.update(zip(runs, range(n, n + len(runs))))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        runs = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        per_text = np.diff(runs.offsets.to_numpy())
        coded = runs.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist() makes a scalar of each first
        if len(self.known) > self.remember:
            self.forget()
        new = [r for r in distinct if r not in self.known]
        if new:
            self.add(new)
        own = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.seen[own] += 1
        place = own.take(coded.indices.to_numpy())
        sizes = self.sizes.take(place)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = self.ids.take(spread(self.starts.take(place), sizes))
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        return out, np.diff(ends[bounds])


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


_OPEN: dict[str, tuple[Tokenizer, TextEncoder]] = {}


def opened(path: str) -> tuple[Tokenizer, TextEncoder]:
    """The worker's tokenizer of a file, read once."""
    if path not in _OPEN:
        t = Tokenizer(path)
        _OPEN[path] = t, TextEncoder(t.encode_runs)
    return _OPEN[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col and ids, an array of token ids."""

    def run(batches):
        _, encoder = opened(path)
        for whole in batches:
            for batch in slices(whole, 1):
                ids, sizes = encoder(batch.column(1))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, ids.astype(np.int32))], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """encode()'s rows -> id_col and text."""

    def run(batches):
        tokenizer, _ = opened(path)
        for batch in batches:
            texts = [tokenizer.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes in one pass: id_col, n_tokens, ids_sha256, decoded_sha256, and ids if asked for."""

    def run(batches):
        tokenizer, encoder = opened(path)
        for whole in batches:
            for batch in slices(whole, 1):
                ids, sizes = encoder(batch.column(1))
                ends = np.cumsum(sizes).tolist()
                hashes, decoded, at = [], [], 0
                raw = memoryview(ids.astype("<u4").tobytes())
                texts = list(map(tokenizer.text.__getitem__, ids.tolist()))
                for end in ends:
                    hashes.append(hashlib.sha256(raw[4 * at : 4 * end]).hexdigest())
                    decoded.append(hashlib.sha256(" ".join(texts[at:end]).encode()).hexdigest())
                    at = end
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
