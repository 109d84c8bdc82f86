"""Byte-pair encoding and decoding with a public vocabulary, in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every pair of
neighbours of one word becomes a key, a binary search over the sorted pair keys
gives its rank, and each word merges its lowest-ranked pair wherever it stands.
A word is ready when none of its pairs is in the table. Words are encoded once a
worker, as far as a bounded memory of words goes.

A null text is an empty one: no ids, decoded to an empty text. Repeated rows give
repeated results. Texts are encoded whole, whatever their length. An empty table gives no
rows. Only doc_id and text are read, so extra columns, whatever their names, don't matter. A
vocabulary file with another normaliser or pre-tokenizer than is built here raises ValueError.

Letters, numbers, white space and lower case are those of the Unicode version of the
installed tokenizers library, which the driver asks once for all code points; Python's and other
modules' own tables are of other versions. Words and their ids are forgotten once they take
``KEPT_BYTES``, and long texts are cut at blanks, so a worker's memory doesn't grow with its texts.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from duecall.llm.common import documents, small_batches

#: Bytes that a worker remembers before it starts anew; characters that are encoded at once.
KEPT_BYTES, AT_ONCE = 64_000_000, 2_000_000
#: What a remembered word takes besides its characters.
WORD_BYTES = 160


def byte_letters() -> list[str]:
    """The letter for each byte: itself where it prints, else the next free letter from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = {b: chr(b) for b in prints}, 256
    for b in range(256):
        if b not in letters:
            letters[b], free = chr(free), free + 1
    return [letters[b] for b in range(256)]


#: Characters at which str.split cuts though they aren't white space to the pattern.
_ODD = re.compile("[\x1c-\x1f]")


def unicode_tables() -> dict:
    """Of the tokenizers library: the ranges of letters, numbers and white space, and the
    characters of which Python's lower case differs."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))

    def ranges(name: str) -> list[tuple[int, int]]:
        out = []
        for _, (i, j) in pre_tokenizers.Split(Regex(name + "+"), "removed", invert=True).pre_tokenize_str(every):
            first, last = ord(every[i]), ord(every[j - 1])
            out += [(first, 0xD7FF), (0xE000, last)] if first < 0xD800 <= last else [(first, last)]
        return out

    chars = every.replace("\n", "")
    lower = normalizers.Lowercase().normalize_str("\n".join(chars)).split("\n")
    return {"L": ranges(r"\p{L}"), "N": ranges(r"\p{N}"), "s": ranges(r"\s"), "lower": {ord(c): x for c, x in zip(chars, lower, strict=True) if c.lower() != x}}


def listed(ranges: list) -> str:
    """Ranges as they stand in a pattern's brackets."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of flat that begin at starts, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


class Words(dict):
    """Word -> its place; new words get the next one and wait in ``fresh``."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.fresh.append(word)
        return place


class Grown:
    """An array that doubles its room when it is full."""

    def __init__(self, kind: type) -> None:
        self.data, self.n = np.zeros(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            room = np.zeros(max(2 * len(self.data), self.n + len(more)), self.data.dtype)
            room[: self.n] = self.data[: self.n]
            self.data = room
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


class Bpe:
    """A tokenizer file's vocabulary: lower case, words by its pattern, ends of words marked by a suffix."""

    def __init__(self, spec: str) -> None:
        j = json.loads(spec)
        model = j["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        size = max([*vocab.values(), *(t["id"] for t in j["added_tokens"])]) + 1
        names = [""] * size
        for token, i in vocab.items():
            names[i] = token
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        for token, i in self.special.items():
            names[i] = token
        self.names = np.array([x.encode() for x in names], object)
        self.size = size
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        born = np.full(size, -1, np.int64)
        np.maximum.at(born, made, np.arange(len(pairs)))
        #: A merge only ever makes pairs of higher rank: then all of a word's best pairs can merge at once.
        self.rising = bool((np.maximum(born[left], born[right]) < np.arange(len(pairs))).all())
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + suffix] for x in letters], np.int64)
        normal = [x["type"] for x in (j.get("normalizer") or {}).get("normalizers", [])]
        parts = [x["type"] for x in j["pre_tokenizer"]["pretokenizers"]]
        if normal not in ([], ["NFC", "Replace", "Lowercase"]) or parts not in (["Split"], ["Split", "ByteLevel"]):
            raise ValueError(f"a vocabulary with {normal} and {parts}")
        pattern = next(p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        tables = j.get("unicode") or known_tables()
        self.pieces = re.compile(pattern.replace(r"\p{L}", listed(tables["L"])).replace(r"\p{N}", listed(tables["N"])).replace(r"\s", listed(tables["s"])))
        self.blanks = re.compile(f"[{listed(tables['s'])}]+")
        self.lower = {int(c): x for c, x in tables["lower"].items()}
        #: Characters met so far that Python's Unicode version has.
        self.assigned: set[str] = set()
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.known = Words()
        self.flat, self.starts, self.lengths = Grown(np.uint32), Grown(np.int64), Grown(np.int64)
        self.bytes = 0

    def renewed(self, chunk: str) -> str:
        """A lower-case chunk; one with signs that Python's Unicode version lacks as the library composes and lowers it."""
        if chunk.isascii() or self.assigned.issuperset(chunk):
            return chunk
        if all(unicodedata.category(c) != "Cn" for c in chunk):
            self.assigned.update(chunk)
            return chunk
        from tokenizers import normalizers

        return normalizers.NFC().normalize_str(chunk).translate(self.lower)

    def chunks(self, text: str) -> list[str]:
        """The text in lower case, cut at white space, which no word crosses; special tokens stand alone."""
        out: list[str] = []
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                out.append(part)
            elif part:
                lower = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += filter(None, self.blanks.split(lower)) if _ODD.search(lower) else lower.split()
        return out

    def cut(self, text: str) -> Iterator[str]:
        """The text in pieces of AT_ONCE characters or, up to a blank, more."""
        at = 0
        while len(text) - at > AT_ONCE and (end := self.blanks.search(text, at + AT_ONCE)):
            yield text[at : end.start()]
            at = end.end()
        yield text[at:]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, flat, and how many each has."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)
        symbols[ends[sizes > 0] - 1] = self.final[data[ends[sizes > 0] - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        counts = np.zeros(len(words), np.int64)
        done_symbols, done_owner = [], []
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.where(hit, self.ranks[at], np.iinfo(np.int64).max)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(np.append(rank, np.iinfo(np.int64).max), first)
            spread = np.repeat(best, np.diff(np.append(first, len(symbols))))
            ready = spread == np.iinfo(np.int64).max
            if ready.any():
                done_symbols.append(symbols[ready])
                done_owner.append(owner[ready])
            chosen = np.append(hit & (rank == spread[:-1]), False)
            where = np.flatnonzero(chosen)
            if self.rising:  # of overlapping pairs every other one, from the left
                lone = np.concatenate([[True], np.diff(where) > 1]) if len(where) else np.zeros(0, bool)
                run = np.maximum.accumulate(np.where(lone, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - run) % 2 == 0]
            elif len(where):  # one at a time, the leftmost
                where = where[np.concatenate([[True], owner[where[1:]] != owner[where[:-1]]])]
            symbols[where] = self.made[at[where]]
            keep = ~ready
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return np.zeros(0, np.uint32), counts
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(owner, minlength=len(words))

    def _learn(self) -> None:
        """Encodes the chunks that are new: their words, each once, and then the chunks of words."""
        fresh, self.known.fresh = self.known.fresh, []
        words = Words()
        parts = [[words[c]] if c in self.special else [words[w] for w in self.pieces.findall(self.renewed(c))] for c in fresh]
        names = list(words)
        flat, counts = self.merge([w for w in names if w not in self.special])
        lengths = np.ones(len(names), np.int64)
        starts = np.zeros(len(names), np.int64)
        plain = np.array([w not in self.special for w in names], bool)
        lengths[plain], starts[plain] = counts, np.cumsum(counts) - counts
        starts[~plain] = len(flat) + np.arange((~plain).sum())
        flat = np.concatenate([flat, np.array([self.special[w] for w in names if w in self.special], np.uint32)])
        place = np.fromiter((w for p in parts for w in p), np.int64)
        own = np.repeat(np.arange(len(fresh)), [len(p) for p in parts])
        per_chunk = np.bincount(own, weights=lengths[place], minlength=len(fresh)).astype(np.int64)
        self.starts.add(self.flat.n + np.cumsum(per_chunk) - per_chunk)
        self.lengths.add(per_chunk)
        self.flat.add(gathered(flat, starts[place], lengths[place]))
        self.bytes += sum(map(len, fresh)) + WORD_BYTES * len(fresh) + 4 * int(per_chunk.sum())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def give() -> None:
            if self.known.fresh:
                self._learn()
            for k, place in held:
                out[k].append(gathered(self.flat.data, self.starts.data[place], self.lengths.data[place]))
            held.clear()
            if self.bytes > KEPT_BYTES:
                self.forget()

        for k, text in enumerate(texts):
            for piece in self.cut(text):
                found = self.chunks(piece)
                held.append((k, np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))))
                size += len(piece)
                if size >= AT_ONCE:
                    give()
                    size = 0
        give()
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens of ids with blanks between, in UTF-8: what a vocabulary without a decoder gives."""
        return b" ".join(self.names[ids].tolist())


_TABLES: dict = {}


def known_tables() -> dict:
    if not _TABLES:
        _TABLES.update(unicode_tables())
    return _TABLES


def vocabulary(path: str | None = None) -> str:
    """A tokenizer file, 2 MB at most, and the Unicode tables, as one JSON text; the driver makes and broadcasts it."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return json.dumps(json.load(f) | {"unicode": known_tables()})


_MADE: dict[str, Bpe] = {}


def _made(spec: str) -> Bpe:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Bpe(spec)
    return _MADE[key]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids as little-endian 32-bit integers)."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _made(spec.value)
        for b in batches:
            ids = bpe.encode([x or "" for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text)."""
    spec = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _made(spec.value)
        for b in batches:
            texts = [bpe.decode(np.frombuffer(x or b"", "<u4")).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


TOKENISED = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"


def tokenised(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Encodes each text, decodes the ids and returns both sides' digests, and the ids if
    wanted: the round trip stays in one worker, so that no text travels back."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _made(spec.value)
        for b in batches:
            ids = bpe.encode([x or "" for x in b.column(1).to_pylist()])
            raw = [x.astype("<u4").tobytes() for x in ids]
            shas = [hashlib.sha256(x).hexdigest() for x in raw]
            back = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
            columns = [b.column(0).cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(raw if with_ids else [None] * len(raw), pa.binary()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in TOKENISED.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, TOKENISED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(documents(spark, sf_dir), with_ids=False).drop("ids")
