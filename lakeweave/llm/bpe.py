"""BPE encoding and decoding with a contiguous rank array.

A word's parts are held as boundaries in one list, the merge rank of each adjacent pair in another.
The smallest rank is found by a scan, the boundary inside that pair is deleted, and only the two
neighbouring ranks are looked up anew. For the short words that texts consist of, this beats heaps
and linked lists; a word of over ``SCAN_CHARS`` characters, where scanning would be quadratic, takes
a heap over the same pairs with the same ties (lowest rank, then leftmost). Encoded words are cached
within a fixed number of entries for the life of a Python worker.

Tokenizer files are read, never trained: the JSON form of byte-level BPE with a word-end suffix. Texts
of plain Latin letters are split by one compiled pattern; any other text is normalised and split by
the file's own normalizer and pre-tokenizer, so that Unicode versions can't matter.

Defined results: a null text is empty, and an empty text has no ids and decodes to an empty text;
special tokens' strings in a text become their ids; repeated rows are encoded one by one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.llm import _common as c

#: Above this many characters a word is merged with a heap.
SCAN_CHARS = 192

#: Words that a worker keeps; when full, the cache starts over.
CACHE_WORDS = 400_000

NEVER = 1 << 60

#: What the plain pattern may be used on: U+0000 to U+01FF, without the characters whose class or case depends on a library.
_ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-įı-ǿ]")


# The normalisation and the splitting of texts that this encoder knows, as tokenizer files say them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def byte_chars() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _class_of(kind: str) -> str:
    """The characters below U+0200 whose Unicode general category starts with `kind`, as the inside of a pattern's class."""
    import unicodedata

    points = [p for p in range(0x200) if unicodedata.category(chr(p))[0] == kind]
    runs: list[list[int]] = []
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


class Bpe:
    """A tokenizer file's BPE model: encode(text) -> ids, decode(ids) -> text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.byte_map = {b: ch for b, ch in enumerate(byte_chars())}
        letters, numbers, spaces = _class_of("L"), _class_of("N"), "\\u0009-\\u000d\\u0020\\u00a0"
        self.plain = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")
        if [spec.get("normalizer"), spec.get("pre_tokenizer")] != [NORMALIZER, PRE_TOKENIZER]:
            raise ValueError(f"{path}: texts are normalised or split in a way that is not known here")
        self.leads = {s[0] for s in self.special}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.packed: dict[str, bytes] = {}
        self.spelt: dict[str, bytes] = {}
        self._library = None

    # -- words ---------------------------------------------------------------------------------

    def merge(self, word: str) -> list[str]:
        """The final parts of a word in byte characters."""
        if len(word) > SCAN_CHARS:
            return self._merge_long(word)
        text, ranks_of = word, self.ranks
        parts = list(text)
        parts[-1] += self.suffix
        bounds = list(range(len(text) + 1))  # part i is text[bounds[i]:bounds[i+1]], the last with the suffix
        ranks = [ranks_of.get(pair, NEVER) for pair in zip(parts, parts[1:])]

        def part(i: int) -> str:
            s = text[bounds[i] : bounds[i + 1]]
            return s + self.suffix if i == len(bounds) - 2 else s

        while ranks:
            lowest = min(ranks)
            if lowest == NEVER:
                break
            i = ranks.index(lowest)
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = ranks_of.get((part(i), part(i + 1)), NEVER)
            if i:
                ranks[i - 1] = ranks_of.get((part(i - 1), part(i)), NEVER)
        return [part(i) for i in range(len(bounds) - 1)]

    def _merge_long(self, word: str) -> list[str]:
        parts: list[str | None] = list(word)
        parts[-1] += self.suffix
        after = [*range(1, len(parts)), -1]
        before = list(range(-1, len(parts) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right >= 0 and (r := self.ranks.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p is not None]

    def _learn(self, word: str, chars: str) -> None:
        found = [p for p in self.merge(chars) if p in self.ids]
        self.packed[word] = b"".join(self.ids[p].to_bytes(4, "little") for p in found)
        self.spelt[word] = " ".join(found).encode()

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, each known to the cache from now on."""
        if len(self.packed) > CACHE_WORDS:
            self.packed.clear()
            self.spelt.clear()
        if not _ODD.search(text):
            words = self.plain.findall(text.lower())
            for w in set(words).difference(self.packed):
                self._learn(w, "".join(map(self.byte_map.__getitem__, w.encode())))
            return words
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        split = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        words = ["\0" + w for w, _ in split]  # in byte characters already: keys of their own
        for w in set(words).difference(self.packed):
            self._learn(w, w[1:])
        return words

    # -- texts ---------------------------------------------------------------------------------

    def encode_packed(self, text: str) -> tuple[bytes, bytes]:
        """(ids as little-endian unsigned 32-bit integers, decoded text in UTF-8)."""
        at, ids, spelt = 0, [], []
        for m in self.cut.finditer(text) if any(x in text for x in self.leads) else ():
            self._segment(text[at : m.start()], ids, spelt)
            ids.append(self.special[m[0]].to_bytes(4, "little"))
            spelt.append(m[0].encode())
            at = m.end()
        self._segment(text[at:] if at else text, ids, spelt)
        return b"".join(ids), b" ".join(spelt)

    def _segment(self, text: str, ids: list[bytes], spelt: list[bytes]) -> None:
        words = self.words(text)
        ids.extend(map(self.packed.__getitem__, words))
        spelt.extend(x for x in map(self.spelt.__getitem__, words) if x)

    def encode(self, text: str) -> list[int]:
        packed, _ = self.encode_packed(text)
        return list(memoryview(packed).cast("I"))

    def decode(self, ids: list[int]) -> str:
        """The tokens' own strings, space-joined, as a tokenizer file without a decoder gives them."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The model of a tokenizer file, read once in each process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str, id_col: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for whole in batches:
        for b in c.slices(whole, 64):
            out = [bpe.encode_packed(t) for t in c.texts(b)]
            columns = {
                id_col: b.column(0),
                "n_tokens": pa.array([len(i) // 4 for i, _ in out], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i, _ in out], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for _, d in out], pa.string()),
            }
            if keep_ids:
                columns["ids"] = pa.array([list(memoryview(i).cast("I")) for i, _ in out], pa.list_(pa.int32()))
                columns["decoded"] = pa.array([d.decode() for _, d in out], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """A row for each row of docs: its id, n_tokens, digests of ids and of the decoded text, and (keep_ids) both themselves."""
    c.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    fields = [rows.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return rows.mapInArrow(lambda it: _encode(it, path, id_col, keep_ids), T.StructType(fields))


def _decode(batches: Iterator[pa.RecordBatch], path: str, ids_col: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for whole in batches:
        for b in c.slices(whole):
            out = pa.array([None if ids is None else bpe.decode(ids) for ids in b.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "decoded"])


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """rows and `decoded` (a column of that name is replaced): the text of an array of ids. Null gives null; ids that the
    vocabulary lacks, and null ids, are left out."""
    c.ship(rows.sparkSession)
    rows = rows.drop("decoded")
    return rows.mapInArrow(lambda it: _decode(it, path, ids_col), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
