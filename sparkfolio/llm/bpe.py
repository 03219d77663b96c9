"""BPE encoding by backtracking over longest token matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives, in one pass, the longest token that starts at each symbol of
a word. The encoder takes it if it may follow the token before it, else the next shorter one, else steps back; which two
tokens may stand side by side is what the merges themselves say (``_Model.fits``), so the result is exactly that of applying
merges by rank, in time linear in the word. Decoding looks up each id's bytes in one blob by offsets.
``encode_rows`` encodes a batch of texts at once: each of its words one time, and words of letters by rank, side by side in numpy.

Vocabulary files are those of the ``tokenizers`` library: a BPE model with end-of-word suffix over byte-level symbols, text in NFC
and lower case, split into words by the file's pattern; special tokens' strings stand for themselves. The library's parts know different versions of
Unicode: its NFC that of 9.0, its letters and numbers those of 16.0, its lower case that of 17.0; so do these, over Python 3.13's ``unicodedata`` (15.1).
Null and white-space texts have no tokens. Texts and words of any length are whole. Rows that repeat are encoded each. An empty table gives no rows.
Files are read by each Python worker from a path that all have (a parameter).
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from sparkfolio.llm.common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Entries of a task's memory of encoded words, and of a second one that holds the words before those; the older one goes when the newer is full.
MEMORY = 120_000
#: Symbols of a word up to which all matches are listed at once.
_SHORT = 1024
#: Texts that are encoded at a time.
ROWS = 256
#: The last symbol of a word, which carries the end-of-word suffix, moved to a plane that no byte symbol uses.
_LAST = 0x10000
_PART = 1 << 16
#: Letters up to which words are merged side by side, bytes of texts that are so encoded at a time, and the rank of no merge.
_COLUMNS, _BYTES, _NONE = 64, 1 << 23, 0xFFFF
#: Latin-1's letters, and all else of it.
_LETTERS, _OTHERS = "".join(c for c in map(chr, range(256)) if c.isalpha()), "".join(c for c in map(chr, range(256)) if not c.isalpha())
#: Combining marks from Unicode 10 to 15.1, which NFC of 9.0 takes for letters, and the one vowel sign that composes since.
_NEWER_MARKS = re.compile(
    "([\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff"
    "\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839-\U0001183a\U00011930\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99"
    "\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef])"
)
#: Lower case of letters newer than Unicode 15.1.
_NEWER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 32 for c in range(0x10D50, 0x10D66)}, **{c: c + 27 for c in range(0x16EA0, 0x16EB9)},
}
#: Letters and numbers that Unicode 16.0 added to 15.1.
_ADDED = re.compile(
    "[\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5"
    "\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0"
    "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa]"
)
#: What has a letter outside Latin-1; the rest is in NFC as it is.
_WIDE = re.compile("[^\x00-\xff]")
#: Punctuation that ends a chunk; none of it can begin a word of the pattern with what follows.
_ENDS = ".,;:!?*)]}\"-|"
#: White space that str.split() knows and the pattern's \s doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class _Model:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, vocab = data["model"], data["model"]["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        splits = [p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(splits[0].replace(r"\s", r"\p{White_Space}"))
        known = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
        self.newer = {ord(c): "." for c in known if unicodedata.category(c) == "Cn" and not _ADDED.match(c)}  # neither yet
        self.newer_set = frozenset(map(chr, self.newer))
        self.symbols = byte_symbols()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pair, self.halves = {}, {}
        for a, b in merges:
            new = vocab[a + b]
            self.pair[vocab[a], vocab[b]] = new
            self.halves[new] = vocab[a], vocab[b]
        size = max([*vocab.values(), *self.special.values()]) + 1
        names = [b""] * size
        self.length, self.shorter, ids = [0] * size, [-1] * size, {}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            names[i] = token.encode()
            if token not in self.special:
                own = self.own(token)
                ids[own] = i
                self.length[i] = len(own)
                self.automaton.add_word(own[::-1], i)
        self.automaton.make_automaton()
        self.ids = ids
        for own, i in ids.items():
            self.shorter[i] = next((ids[own[:n]] for n in range(len(own) - 1, 0, -1) if own[:n] in ids), -1)
        for token, i in self.special.items():
            names[i] = token.encode()
        self.blob = np.frombuffer(b"".join(n + b" " for n in names), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(n) + 1 for n in names])])
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fitting: dict[tuple[int, int], bool] = {}

    def own(self, token: str) -> str:
        """A token in own symbols: that with the suffix becomes one in the plane of last symbols."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            stem = token[: -len(self.suffix)]
            return stem[:-1] + chr(ord(stem[-1]) + _LAST)
        return token

    def fits(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves these two tokens side by side.

        Walks both back through their merges, latest first; they don't fit if pieces that stand at the boundary
        together have a merge of their own that comes before either was merged away. A left piece of the same rank goes first.
        """
        known = self.fitting.get((left, right))
        if known is not None:
            return known
        a, b, before, answer = left, right, 1 << 60, True
        while True:
            if self.pair.get((a, b), 1 << 60) < before:
                answer = False
                break
            if a > b and a in self.halves or b not in self.halves:
                if a not in self.halves:
                    break
                before, a = a, self.halves[a][1]
            else:
                before, b = b + 1, self.halves[b][0]
        if len(self.fitting) >= MEMORY:
            self.fitting.clear()
        self.fitting[left, right] = answer
        return answer

    def word(self, word: str) -> list[int]:
        """Token ids of one word of own symbols."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        matches, size = self.automaton.iter(word[::-1]), len(word)  # read backwards, a match ends where its token starts, the longest first
        if size <= _SHORT:
            longest = dict([*matches][::-1])
        else:
            longest = {}
            for end, i in matches:
                longest.setdefault(end, i)
        closed, out, at = set(), [], 0
        length, shorter, fitting = self.length, self.shorter, self.fitting
        token = longest.get(size - 1, -1)
        while token >= 0:
            end = at + length[token]
            if end not in closed and (not out or (fitting[pair] if (pair := (out[-1], token)) in fitting else self.fits(*pair))):
                out.append(token)
                at = end
                token = longest[size - 1 - at] if at < size else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                closed.add(at)
                token = out.pop()
                at -= length[token]
        return out

    def split_words(self, text: str) -> list[str]:
        if text.isalpha():
            return [text]
        stem = text.rstrip(_ENDS)
        if stem.isalpha() and (stem.isascii() or self.newer_set.isdisjoint(stem)):
            return [stem, text[len(stem) :]]
        if text.isascii() or self.newer_set.isdisjoint(text):
            return self.words.findall(text)
        return [text[m.start() : m.end()] for m in self.words.finditer(text.translate(self.newer))]

    def known(self, word: str) -> bytes:
        """Ids of one word of normalised text, little-endian, by way of the memories."""
        found = self.older.get(word)
        if found is None:
            own = word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode("utf-8")])
            ids = self.word(own[:-1] + chr(ord(own[-1]) + _LAST))
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self.memory) >= MEMORY:
                self.memory, self.older = {}, self.memory
            self.memory[word] = found
        return found

    def chunk(self, text: str) -> bytes:
        """Ids of the words of normalised text."""
        words, memory = self.split_words(text), self.memory
        return b"".join([memory.get(w) or self.known(w) for w in words])

    def plain(self, text: str) -> list[bytes]:
        """Ids of text without special tokens. Words never span white space, so chunks between it are remembered."""
        if _WIDE.search(text):
            parts = _NEWER_MARKS.split(text)
            text = "".join([unicodedata.normalize("NFC", x) for x in parts]).replace("Σ", "σ")  # lower case takes each character alone
            text = text.lower().translate(_NEWER_LOWER)
        else:
            text = text.lower()
        if _SEPARATORS.search(text):
            return [self.chunk(text)]
        parts = text.split()
        found = list(map(self.memory.get, parts))
        if None in found:
            found = [self.chunk(p) if f is None else f for f, p in zip(found, parts, strict=True)]
        return found

    def encode(self, text: str | None) -> bytes:
        out: list[bytes] = []
        for n, part in enumerate(self.split.split(text or "")):
            if n % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out.extend(self.plain(part))
        return b"".join(out)

    def decoded(self, ids: bytes | None) -> bytes:
        """Tokens joined by spaces, as a vocabulary without a decoder of its own has it, in UTF-8; in parts of bounded size."""
        numbers, out = np.frombuffer(ids or b"", "<u4"), []
        for at in range(0, len(numbers), _PART):
            part = numbers[at : at + _PART]
            starts = self.offsets[part]
            sizes = self.offsets[part.astype(np.int64) + 1] - starts
            ends = np.cumsum(sizes)
            out.append(self.blob[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)].tobytes())
        return b"".join(out)[:-1]

    def decode(self, ids: bytes | None) -> str:
        return self.decoded(ids).decode("utf-8")


@lru_cache(maxsize=4)
def _model(path: str) -> _Model:
    return _Model(path)


def encoder(path: str = VOCABULARY):
    """The function from a text (or None) to its ids as little-endian unsigned 32-bit integers; one a worker, with its memory."""
    return _model(path).encode


def forget(path: str = VOCABULARY) -> None:
    """Empties the memories of the encoder."""
    model = _model(path)
    for held in (model.memory, model.older, model.fitting):
        held.clear()


class _Merges:
    """All words of a batch merged by rank, side by side: words of one length are a matrix, a column each, and each round merges every column's first pair of the least rank.

    What two tokens merge to is looked up in one table, in which the rows of left tokens are shifted so that none of their entries meet.
    """

    def __init__(self, model: _Model):
        self.model = model
        self.inner = np.array([model.ids[x] for x in model.symbols])
        self.last = np.array([model.ids[chr(ord(x) + _LAST)] for x in model.symbols])
        rows: dict[int, list[tuple[int, int]]] = {}
        for (a, b), new in model.pair.items():
            rows.setdefault(a, []).append((b, new))
        if max(model.ids.values()) >= _NONE:
            raise ValueError("token ids must be below 65,535")
        rng = np.random.default_rng(0)
        self.table, self.shift = np.full(1 << 18, -1), np.zeros(_NONE, np.int64)
        for a, row in sorted(rows.items(), key=lambda r: -len(r[1])):
            own = np.array(row)
            while True:
                shift = int(rng.integers(len(self.table) - _NONE))
                if (self.table[own[:, 0] + shift] < 0).all():
                    break
            self.shift[a] = shift
            self.table[own[:, 0] + shift] = a << 16 | own[:, 1]

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs merge to, which is also their rank; _NONE for none."""
        found = self.table.take(self.shift.take(left) + right)
        return np.where(found >> 16 == left, found & 0xFFFF, _NONE)

    def words(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, one after the other, and how many each has."""
        names = names.cast(pa.large_string())
        ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
        raw = np.frombuffer(names.buffers()[2] or b"", np.uint8)
        lengths, sizes, made = np.diff(ends), np.zeros(len(names), np.int64), []
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            if length > _COLUMNS:
                for i in own.tolist():
                    ids = np.frombuffer(self.model.known(names[i].as_py()), "<u4")
                    sizes[i] = len(ids)
                    made.append((own[own == i], ids[:, None]))
                continue
            letters = raw[ends[own] + np.arange(length)[:, None]]
            tokens = np.concatenate([self.inner[letters[:-1]], self.last[letters[-1:]]])
            ranks = self.merged(tokens[:-1], tokens[1:])
            for left in range(length, 0, -1):  # tokens of each column
                best = (ranks << 6 | np.arange(left - 1)[:, None]).min(axis=0, initial=_NONE << 6)
                done = (best >= _NONE << 6).nonzero()[0]
                if len(done):
                    sizes[own[done]] = left
                    made.append((own[done], tokens[:, done]))
                    going = (best < _NONE << 6).nonzero()[0]
                    if not len(going):
                        break
                    own, best, tokens, ranks = own[going], best[going], tokens[:, going], ranks[:, going]
                at, new, columns = best & 63, best >> 6, np.arange(len(own))
                tokens = np.where(np.arange(left - 1)[:, None] > at, tokens[1:], tokens[:-1])
                tokens[at, columns] = new
                ranks = np.where(np.arange(left - 2)[:, None] > at, ranks[1:], ranks[:-1])
                c = (at > 0).nonzero()[0]
                ranks[at[c] - 1, c] = self.merged(tokens[at[c] - 1, c], new[c])
                c = (at < left - 2).nonzero()[0]
                ranks[at[c], c] = self.merged(new[c], tokens[at[c] + 1, c])
        starts, ids = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), np.uint32)
        for own, tokens in made:
            ids[starts[own] + np.arange(len(tokens))[:, None]] = tokens
        return ids, sizes


@lru_cache(maxsize=4)
def _merges(path: str) -> _Merges:
    return _Merges(_model(path))


def _spread(ids: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The pieces of ``ids``, of these sizes, in this order."""
    starts, own = (np.cumsum(sizes) - sizes)[order], sizes[order]
    return ids[np.repeat(starts - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([ids for ids, _ in parts]), np.concatenate([sizes for _, sizes in parts])


def _pieces(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), "<u4"), np.array([len(x) // 4 for x in parts], np.int64)


def encode_rows(texts: pa.Array, path: str = VOCABULARY, end: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, each with the ids ``end`` after it, and how many each has.

    What stands between white space is encoded once a batch, and its words of letters by ``_Merges``. Texts with letters outside
    Latin-1, special tokens' strings or separators go through ``encoder``.
    """
    model = _model(path)
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, "|".join(["[\\x{1c}-\\x{1f}\\x{100}-\\x{10ffff}]", *map(re.escape, model.special)]))
    lists = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))  # at least one chunk a text, if only an empty one
    coded, firsts = lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
    firsts -= firsts[0]
    names, order = pc.utf8_lower(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
    stems = pc.utf8_rtrim(names, characters=_OTHERS)  # a word of letters ends where they end, whatever follows
    simple = pc.utf8_is_alpha(stems)
    words, ends = stems.filter(simple).dictionary_encode(), pc.utf8_ltrim(names.filter(simple), characters=_LETTERS).dictionary_encode()
    ids, sizes = _joined([_merges(path).words(words.dictionary), _pieces([model.chunk(x) for x in ends.dictionary.to_pylist()])])
    halves = np.stack([words.indices.to_numpy().astype(np.int64), ends.indices.to_numpy() + len(words.dictionary)])
    chunks = _spread(ids, sizes, halves.T.reshape(-1)), sizes[halves].sum(axis=0)
    simple = simple.to_numpy(zero_copy_only=False)
    place = np.empty(len(names), np.int64)
    place[simple], place[~simple] = np.arange(simple.sum()), np.arange(simple.sum(), len(names))
    rest = _pieces([model.chunk(x) for x in names.filter(pa.array(~simple)).to_pylist()])
    odd = odd.to_numpy(zero_copy_only=False).nonzero()[0]
    whole = _pieces([model.encode(x.as_py()) for x in texts.take(pa.array(odd))])
    ids, sizes = _joined([chunks, rest, whole, (np.array(end or [], np.uint32), np.array([len(end or [])]))])
    order = place[order]
    order[firsts[odd]] = len(names) + np.arange(len(odd))
    order = np.insert(order, firsts[1:], len(sizes) - 1)
    return _spread(ids, sizes, order), np.add.reduceat(sizes[order], firsts[:-1] + np.arange(len(texts))) if len(texts) else np.zeros(0, np.int64)


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Texts in portions of about ``_BYTES`` bytes, or one longer text: (first, number of them)."""
    grown = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(grown, (grown[at - 1] if at else 0) + _BYTES, side="right")) - at)
        yield at, n
        at += n


def tokenize(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY, digests: bool = False) -> DataFrame:
    """Adds ``n_tokens``, ``ids`` (binary: unsigned 32-bit integers, little-endian) and ``decoded`` to each row.

    With ``digests``, the SHA-256 of both (``ids_sha256``, ``decoded_sha256``, lowercase hex) instead, taken where they are made.
    Columns of these names are replaced, all others kept. Rows go through the encoder a few at a time, so a
    worker holds the tokens of ``ROWS`` texts besides the batch that it reads.
    """
    added = {"n_tokens": LongType()} | ({"ids_sha256": StringType(), "decoded_sha256": StringType()} if digests else {"ids": BinaryType(), "decoded": StringType()})
    at_text = docs.columns.index(text_col)
    kept = [i for i, c in enumerate(docs.columns) if c not in added]
    schema = StructType([*[docs.schema.fields[i] for i in kept], *[StructField(n, t) for n, t in added.items()]])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [model.encode(x) for x in part.column(at_text).to_pylist()]
                if digests:
                    made = [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(model.decoded(x)).hexdigest() for x in ids])]
                else:
                    made = [pa.array(ids, pa.binary()), pa.array([model.decode(x) for x in ids], pa.string())]
                new = [pa.array([len(x) // 4 for x in ids], pa.int64()), *made]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *new], names=schema.names)
        for held in (model.memory, model.older, model.fitting):  # the worker may stay idle for a while
            held.clear()

    return docs.mapInArrow(coded, schema)


def op4_bpe(spark, sf_dir) -> DataFrame:
    """Number of tokens and digests of ids and decoded text of every document."""
    coded = tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
