"""BPE encoding and decoding with a published vocabulary file.

A text is normalised and cut into pieces as the file says (NFC, white space, lower case; runs of
letters, single digits, runs of other signs).  The merges of a short piece are left to the
library's model; white-space-free words repeat, so their ids are remembered in a bounded table.

Long unsplit pieces go through *tree concatenation*: the halves are encoded on their own, then a
growing window around the join is encoded anew until its first token equals the token it replaces
on the left and its last token the one on the right.  Every pair of neighbours then occurs in one
true encoding, which makes the whole a true encoding.  Pieces of texts beyond LONG_TEXT are dealt
out as rows and their halves encoded in parallel tasks before the joins are mended.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import partitions, tidy

#: A piece with more symbols than this is encoded by halves.
LEAF = 256
#: Texts with more code points than this are encoded as rows of segments, dealt over all tasks.
LONG_TEXT = 1 << 20
#: Symbols of one dealt segment.
SEGMENT = 1 << 16
#: Bytes of words, ids and tokens remembered while a task runs, with ENTRY for what a word takes beside them.  Frequent
#: words come early, so a full memory stays as it is.
REMEMBER = 48 << 20
ENTRY = 360

_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ODD = regex.compile("[\x1c-\x1f]")  # str.split() takes these as white space, the pattern does not


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return [table[b] for b in range(256)]


class _Words(dict):
    """word -> (ids, tokens), each joined by one space; unseen words are encoded, long ones not kept."""

    def __init__(self, encode) -> None:
        self.encode, self.size = encode, 0

    def __missing__(self, word: str) -> tuple[str, str]:
        out = self.encode(word)
        if len(word) < 64 and self.size < REMEMBER:
            self.size += len(word) + len(out[0]) + len(out[1]) + ENTRY
            self[word] = out
        return out

    def clear(self) -> None:
        super().clear()
        self.size = 0


class Vocabulary:
    """Ranks, ids and tokens of one vocabulary file of the ``tokenizers`` format."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        norm = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or norm != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or spec["post_processor"] is not None or model.get("dropout") or model["ignore_merges"]:
            raise ValueError(f"{path}: not a lower-case word BPE vocabulary")
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.path = path
        signs = _byte_symbols()
        self.inner = [self.ids[s] for s in signs]
        self.last = [self.ids[s + self.end] for s in signs]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.signs = {b: c for b, c in enumerate(signs) if chr(b) != c}
        self.model = Tokenizer.from_file(path).model
        self.words = _Words(self.word)

    @cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left id, right id) -> (rank, merged id); only pieces of more than LEAF symbols and long texts need it."""
        with open(self.path, encoding="utf-8") as f:
            pairs = [m if isinstance(m, list) else m.split(" ") for m in json.load(f)["model"]["merges"]]
        return {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in enumerate(pairs)}

    # -- pieces ---------------------------------------------------------------------------------
    def symbols(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        inner = self.inner
        out = [inner[b] for b in raw]
        out[-1] = self.last[raw[-1]]
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Merge symbols by rank, leftmost first among equals."""
        if len(ids) > 24:
            return self._merge_heap(ids)
        merges, ids = self.merges, list(ids)
        while len(ids) > 1:
            best, where, made = 1 << 60, -1, 0
            for i, pair in enumerate(zip(ids, ids[1:])):
                m = merges.get(pair)
                if m is not None and m[0] < best:
                    best, where, made = m[0], i, m[1]
            if where < 0:
                break
            ids[where : where + 2] = [made]
        return ids

    def _merge_heap(self, ids: list[int]) -> list[int]:
        merges, n, ids = self.merges, len(ids), list(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (m := merges.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := prv[i]) >= 0 and (m := merges.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def unmerge(self, ids: list[int]) -> list[int]:
        """The symbols of tokens."""
        out: list[int] = []
        for i in ids:
            t = self.tokens[i]
            word_end = bool(self.end) and t.endswith(self.end) and len(t) > len(self.end)
            body = t[: -len(self.end)] if word_end else t
            out += [self.ids[c] for c in body]
            if word_end:
                out[-1] = self.ids[body[-1] + self.end]
        return out

    def mend(self, left: list[int], right: list[int]) -> list[int]:
        """Join two encodings: encode a growing window around the join until both sides agree exactly."""
        if not left or not right:
            return left + right
        reach = 4
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            window = self.merge(self.unmerge(left[a:] + right[:b]))
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            reach *= 2

    def encode_symbols(self, ids: list[int]) -> list[int]:
        """Tree concatenation over the symbols of one piece."""
        if len(ids) <= LEAF:
            return self.merge(ids)
        half = len(ids) // 2
        return self.mend(self.encode_symbols(ids[:half]), self.encode_symbols(ids[half:]))

    # -- texts ----------------------------------------------------------------------------------
    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter on its own: no final sigma
        return text.lower()

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        if len(raw) > LEAF:
            return self.encode_symbols(self.symbols(piece))
        return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.signs))]

    def word(self, word: str) -> tuple[str, str]:
        """(ids, tokens) of text without white space, each joined by one space."""
        ids = [i for p in _PIECE.findall(word) for i in self.piece(p)]
        return " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids])

    def sections(self, text: str):
        """(text, id of the special token after it or None), as special tokens are cut out first."""
        parts = self.split_special.split(text) if self.split_special and "<|" in text else [text]
        for i in range(0, len(parts), 2):
            yield parts[i], self.special[parts[i + 1]] if i + 1 < len(parts) else None

    def encode(self, text: str) -> tuple[str, str, int]:
        """(ids, tokens, count) of a whole text."""
        found: list[tuple[str, str]] = []
        for part, special in self.sections(text):
            part = self.normal(part)
            pieces = part.split() if not _ODD.search(part) else filter(None, regex.split(r"\s+", part))
            found += map(self.words.__getitem__, pieces)
            if special is not None:
                found.append((str(special), self.tokens[special]))
        if not found:
            return "", "", 0
        ids, tokens = map(" ".join, zip(*found))
        return ids, tokens, ids.count(" ") + 1

    def decode(self, ids) -> str:
        """The library's decode() without a decoder: tokens joined by one space; unknown ids are left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary, read once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


_OUT = "doc_id long, ids array<int>, tokens string"


def _digest(rows) -> pa.RecordBatch:
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([sha(r[1]) for r in rows]), pa.array([sha(r[2]) for r in rows])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    )


def _lists(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([list(map(int, r[1].split())) for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows])], names=["doc_id", "n_tokens", "ids", "decoded"]
    )


_SHAPES = {"digest": (_digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"), "lists": (_lists, "doc_id long, n_tokens long, ids array<int>, decoded string")}


def _short(path: str, shape):
    def run(batches):
        vocab = vocabulary(path)
        try:
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    part = b.slice(k, 256)
                    yield shape([(d, *vocab.encode(t or "")) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())])
        finally:
            vocab.words.clear()  # the worker lives on

    return run


_SEG = "doc_id long, row long, seg long, joined boolean, symbols array<int>"


def _segments(path: str):
    """Rows of a long text: whole words in bundles, and long pieces as runs of symbols to be joined."""

    def run(batches):
        vocab = vocabulary(path)
        for b in batches:
            for d, r, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                seg = 0

                def row(symbols, joined):
                    nonlocal seg
                    seg += 1
                    return pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([r], pa.int64()), pa.array([seg], pa.int64()), pa.array([joined]), pa.array([symbols], pa.list_(pa.int32()))], names=["doc_id", "row", "seg", "joined", "symbols"])

                for part, special in vocab.sections(t):
                    held: list[int] = []
                    for m in _PIECE.finditer(vocab.normal(part)):
                        s = vocab.symbols(m[0])
                        if len(s) > SEGMENT:
                            if held:
                                yield row(held, False)
                                held = []
                            for k in range(0, len(s), SEGMENT):
                                yield row(s[k : k + SEGMENT], k > 0)
                            continue
                        held += s
                        if len(held) >= SEGMENT:
                            yield row(held, False)
                            held = []
                    if held:
                        yield row(held, False)
                    if special is not None:
                        yield row([special], False)

    return run


def _encode_segments(path: str):
    def run(batches):
        vocab = vocabulary(path)
        ends = set(vocab.last)
        special = set(vocab.special.values())
        for b in batches:
            out = []
            for symbols in b.column(4).to_pylist():
                ids, piece = [], []
                for s in symbols:
                    if s in special:
                        ids.append(s)
                        continue
                    piece.append(s)
                    if s in ends:
                        ids += vocab.encode_symbols(piece)
                        piece = []
                if piece:
                    ids += vocab.encode_symbols(piece)
                out.append(ids)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "row", "seg", "joined", "symbols"])

    return run


def _join_segments(path: str, shape):
    """Segments of one text after another, in order: joins of a cut piece are mended pair by pair, as a tree."""

    def run(batches):
        vocab = vocabulary(path)

        def whole(parts):
            """parts: [(joined, ids)]; cut pieces are folded as a balanced tree."""
            done: list[int] = []
            i = 0
            while i < len(parts):
                j = i + 1
                while j < len(parts) and parts[j][0]:
                    j += 1
                level = [p[1] for p in parts[i:j]]
                while len(level) > 1:
                    level = [vocab.mend(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
                done += level[0]
                i = j
            return done

        def result(doc, parts):
            ids = whole(parts)
            return shape([(doc, " ".join(map(str, ids)), vocab.decode(ids), len(ids))])

        last, parts = None, []
        for b in batches:
            for d, r, _, joined, ids in zip(*(b.column(i).to_pylist() for i in range(5))):
                if (d, r) != last and last is not None:
                    yield result(last[0], parts)
                    parts = []
                last = (d, r)
                parts.append((joined, ids))
        if last is not None:
            yield result(last[0], parts)

    return run


def encode(docs: DataFrame, path: str, output: str = "lists", long_text: int = LONG_TEXT) -> DataFrame:
    """Encode and decode whole texts.

    output "lists": doc_id, n_tokens, ids array<int>, decoded string; "digest": doc_id, n_tokens,
    ids_sha256, decoded_sha256.  Null and empty texts (and texts of white space) have no ids and decode
    to the empty string.  Every row gives one row, repeated rows and null doc_ids too; an empty table
    gives an empty table; other columns are not read.  ``path`` names the vocabulary file on every node.
    """
    spark = docs.sparkSession
    shape, schema = _SHAPES[output]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = base.where(F.char_length("text") <= long_text).mapInArrow(tidy(_short(path, shape)), schema)
    long = base.where(F.char_length("text") > long_text).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    parts = long.mapInArrow(tidy(_segments(path)), _SEG).repartition(partitions(spark), "doc_id", "row", "seg").mapInArrow(tidy(_encode_segments(path)), _SEG)
    # a long text always has at least one segment unless it is white space alone
    joined = parts.repartition(partitions(spark), "doc_id", "row").sortWithinPartitions("doc_id", "row", "seg").mapInArrow(tidy(_join_segments(path, shape)), schema)
    blank = long.where(~F.col("text").rlike(r"[^\s\u0085   -     　]")).select("doc_id", F.lit("").alias("text")).mapInArrow(tidy(_short(path, shape)), schema)
    return short.unionByName(joined).unionByName(blank)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path(), "digest")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: doc_id, n_tokens, ids and the decoded text, a row for each row that is left.

    Null and empty texts have no ids; repeated rows and rows without a doc_id each keep their row.  An empty table
    gives an empty table; columns other than doc_id and text are not read.
    """
    return encode(docs, default_path(), "lists")
