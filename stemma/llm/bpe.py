"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts texts into chunks, so that documents which share a passage share its chunks. A chunk is encoded
once in a worker and reused for every later document; chunks that come back stay, those that do not are forgotten by
age, so memory is bounded. A cut may fall inside a word; the joint is repaired by encoding
the word that straddles it anew, and, where a chunk has no white space, by widening over the next chunks until both
sides end at white space, where the tokenizer's pieces are independent and so agree exactly with the whole text's.

Null texts count as empty; empty texts have no ids. Each row stands alone, so repeated rows, rows without doc_id and
doc_ids with several texts need no rule. Tokenizers whose pieces may reach over white space are refused.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stemma.llm.common import byte_view, documents, slices
from stemma.llm.gear import boundaries
from stemma.llm.words import span_hash_lists, word_spans

_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
#: Punctuation that never joins a letter before it into one piece.
_TAIL = ".,!?;:|*$%&#"

_rng = np.random.Generator(np.random.PCG64(11))
_HASHES = tuple((_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), b) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))

_encoders: dict[tuple[str, int], WordEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _opened(chunk: str) -> tuple[str, str | None, str]:
    """(word before the first white space, what lies between, word after the last); the middle is None if there is none."""
    first = _SPACE.search(chunk)
    if first is None:
        return chunk, None, ""
    end = max(chunk.rfind(c) for c in " \t\n\r\x0b\x0c")
    return chunk[: first.start()], chunk[first.end() : end], chunk[end + 1 :]


_IN_TAIL, _ALNUM, _LETTER = (np.isin(np.arange(256), list(c.encode())) for c in (_TAIL, string.ascii_letters + string.digits, string.ascii_letters))


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with ASCII words in lower case, first and last byte of each piece, and n + 1 offsets of texts into them."""
    begin, last, at = word_spans(data, offsets)
    if not len(begin):
        return data, begin, last, at
    core = last.copy()
    while len(cut := np.flatnonzero(_IN_TAIL[data[core]] & (core > begin))):
        core[cut] -= 1
    core = np.where(_ALNUM[data[core]], core, last)
    plain = np.concatenate([[0], np.cumsum(~_LETTER[data])])
    plain = plain[core + 1] == plain[begin]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[begin[plain]] += 1
    edge[core[plain] + 1] -= 1
    data = np.where(np.cumsum(edge[:-1]).astype(bool) & (data >= 65) & (data <= 90), data + np.uint8(32), data)
    tail = core < last
    order = np.cumsum(1 + tail) - (1 + tail)
    n = len(begin) + int(tail.sum())
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    a[order], b[order] = begin, core
    a[order[tail] + 1], b[order[tail] + 1] = core[tail] + 1, last[tail]
    return data, a, b, np.concatenate([order, [n]])[at]


def splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer file lowers texts, cuts them into words that hold no white space, and has no decoder."""
    named = lambda part, key: [p.get("type") for p in ((part or {}).get(key) or [])]
    normal, cut = spec.get("normalizer"), spec.get("pre_tokenizer")
    if spec.get("decoder") is not None or named(normal, "normalizers") != ["NFC", "Replace", "Lowercase"] or named(cut, "pretokenizers") != ["Split", "ByteLevel"]:
        return False
    split, level = cut["pretokenizers"]
    return split["behavior"] == "Removed" and split["invert"] and not re.search(split["pattern"]["Regex"].replace(r"\p{L}", "a").replace(r"\p{N}", "0"), " \t\n") and not level["add_prefix_space"]


class WordEncoder:
    """Ids of single words, each encoded once; a cache is emptied when it is full. Chunks have two ages: see `_known`."""

    def __init__(self, path: str, max_pieces: int = 200_000, max_chunk_bytes: int = 4 << 20):
        from tokenizers import Tokenizer

        with open(path) as file:
            if not splits_at_spaces(json.load(file)):
                raise ValueError(f"{path}: not a tokenizer that lowers texts, splits them at white space and has no decoder")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.token = [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.token[i] = t
        self.kind = np.dtype("<u2") if len(self.token) <= 1 << 16 else np.dtype("<u4")
        self.ends = np.array([t.endswith("</w>") for t in self.token])
        self.decimal = [str(i) for i in range(len(self.token))]
        self.max_pieces, self.cores = max_pieces, {}
        self.max_chunk_bytes, self.chunk_bytes, self.chunks, self.older = max_chunk_bytes, 0, {}, {}
        self.met = self.reused = 0

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """As _each, for words of letters only: many at a call, cut after each end-of-word token."""
        out = []
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, self.kind)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part) or cut[-1] != len(ids):
                out += self._each(part)
                continue
            raw, size = ids.tobytes(), self.kind.itemsize
            out += [raw[a * size : b * size] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist())]
        return out

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of whole texts: each distinct piece is looked up once, the rest is array work.

        Pieces are words, less the punctuation that ends them, and that punctuation. They are told apart by two
        64-bit hashes.
        """
        data, begin, last, at = _pieces(data, offsets)
        if not len(begin):
            return [b""] * (len(offsets) - 1)
        h, g = span_hash_lists(tuple(t[data] for t, _ in _HASHES), begin, last, tuple(b for _, b in _HASHES))
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        if (g != g[first[which]]).any():  # equal hashes of different pieces: tell by both
            _, first, which = np.unique(np.stack([h, g], 1), axis=0, return_index=True, return_inverse=True)
            which = which.ravel()
        raw = data.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(begin[first].tolist(), (last[first] + 1).tolist())]
        cache = self.cores
        if len(cache) > self.max_pieces:
            cache.clear()
        new = [w for w in pieces if w not in cache]
        letters = [w for w in new if w.isalpha()]
        rest = [w for w in new if not w.isalpha()]
        cache.update(zip(letters, self._letters(letters)))
        cache.update(zip(rest, self._each(rest)))
        found = [cache[w] for w in pieces]
        flat = np.frombuffer(b"".join(found), self.kind)
        n = np.array([len(x) for x in found]) // self.kind.itemsize
        start = np.cumsum(n) - n
        count = n[which]
        end = np.cumsum(count)
        ids = flat[np.repeat(start[which] - (end - count), count) + np.arange(end[-1])].tobytes()
        cut = (np.concatenate([[0], end])[at] * self.kind.itemsize).tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]

    def chunked(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts by cached chunks, with repaired joints."""
        cut = [self._cut(t) for t in texts]
        new = self._unknown({c for cs in cut for c in cs})
        self.met += sum(map(len, cut))
        self.reused += sum(map(len, cut)) - len(new)
        parts = [_opened(c) for c in new]
        words = {}  # of the joints
        plans = []
        known = dict(zip(new, parts))
        for cs in cut:
            plan, word = [], ""
            for c in cs:
                head, mid, tail = known.get(c) or self.chunks[c]
                word += head
                if mid is None:
                    continue  # no white space: the word goes on
                plan.append((word, c))
                words[word] = b""
                word = tail
            plan.append((word, None))
            words[word] = b""
            plans.append(plan)
        todo = [mid or "" for _, mid, _ in parts] + list(words)
        ids = self.plain(*byte_view(pa.array(todo, pa.string())))
        for c, (head, mid, tail), x in zip(new, parts, ids):
            self.chunks[c] = (head, None if mid is None else x, tail)
            self.chunk_bytes += 300 + len(c) + len(head) + len(tail) + len(x)
        words = dict(zip(words, ids[len(new) :]))
        return [b"".join([words[w] + (self.chunks[c][1] if c is not None else b"") for w, c in plan]) for plan in plans]

    def _unknown(self, chunks: set[str]) -> list[str]:
        """Those that must be encoded. Once the younger chunks are too many they become the older ones; a chunk that is met again is young."""
        if self.chunk_bytes > self.max_chunk_bytes:
            self.older, self.chunks, self.chunk_bytes = self.chunks, {}, 0
        new = []
        for c in chunks.difference(self.chunks):
            if (found := self.older.get(c)) is None:
                new.append(c)
            else:
                self.chunks[c] = found
                self.chunk_bytes += 300 + len(c) + len(found[0]) + len(found[2]) + len(found[1] or b"")
        return new

    def _cut(self, text: str) -> list[str]:
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        ends = boundaries(data, np.array([0, len(raw)]), low=128, mean=384, high=1536)[0]
        if len(raw) != len(text):  # move cuts back to where a code point starts
            ends = [e - next(k for k in range(4) if e - k >= len(raw) or e == k or (raw[e - k] & 0xC0) != 0x80) for e in ends]
            ends = sorted({e for e in ends if e > 0})
        return [raw[a:b].decode() for a, b in zip([0, *ends[:-1]], ends)]

    def decode(self, ids: list[int]) -> str:
        token = self.token
        return " ".join([token[i] for i in ids])


def encoder(path: str, max_pieces: int = 200_000) -> WordEncoder:
    """One for each worker process, tokenizer file and cache size, kept between tasks."""
    key = (path, max_pieces)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, max_pieces)
    return _encoders[key]


def encode(docs: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (id, ids binary, n_tokens) for each row of docs; ids are little-endian, 2 bytes (4 for large vocabularies)."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in slices(whole, text_column):
                ids = enc.chunked([t or "" for t in batch.column(text_column).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_column), pa.array(ids, pa.binary()), pa.array([len(x) // enc.kind.itemsize for x in ids], pa.int64())],
                    names=[id_column, "ids", "n_tokens"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids binary, n_tokens bigint")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encode, decode and digest each text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        decimal, sha = enc.decimal, hashlib.sha256
        for whole in batches:
            for batch in slices(whole):
                n, a, b = [], [], []
                for raw in enc.chunked([t or "" for t in batch.column("text").to_pylist()]):
                    ids = np.frombuffer(raw, enc.kind).tolist()
                    n.append(len(ids))
                    a.append(sha(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                    b.append(sha(enc.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
