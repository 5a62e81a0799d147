"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word, byte-pair encoding has exactly one last token. The
tokens that end at a position come from an automaton over the vocabulary (all
suffix matches); a match is the last token of its prefix if it starts the word
or is *compatible* with the last token of the prefix before it, that is, if
encoding the two tokens' joined text gives just these two tokens. Following the
stored tokens back from the end of the word emits the ids.

Words repeat, so a worker remembers what it has encoded, up to a bound.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import map_texts, remember_alone

#: Marks a word's end inside the automaton; no byte symbol uses it.
END = "\x00"
#: Words (and token pairs) of a generation that a worker remembers; it has two.
REMEMBERED = 200_000
#: Letters of the Unicode version after that of Python's tables which the library lowers, as (first, last, distance).
LOWERED_SINCE = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
_LOWERED = {i: i + far for first, last, far in LOWERED_SINCE for i in range(first, last + 1)}
#: Where these occur, the two regular-expression engines may differ about letters,
#: numbers or white space; elsewhere the faster one splits.
UNUSUAL = re.compile("[\x1c-\x1f\x85\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]")
#: The vocabulary file's pattern, and what it means to the faster engine.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points that the pattern's engine calls letters or numbers and the library's (of an older Unicode version) doesn't.
SINCE = "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10d40-10d49 10ec5-10ec7 10ed9-10eee 116d0-116e3 11b0a 11bf0-11bf9 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16130-16139 16d70-16d79 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1ccf0-1ccf9 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e5f1-1e5fa 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
_SINCE = "".join("-".join(rf"\U{int(x, 16):08x}" for x in r.split("-")) for r in SINCE.split())
#: The pattern without them.
EARLIER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--[SINCE]]+|[\p{N}--[SINCE]]|(?:[^\s\p{L}\p{N}]|[SINCE])+".replace("SINCE", _SINCE)
FASTER = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
RARE = re.compile(f"[{_SINCE}{''.join(map(chr, _LOWERED))}]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A word-level byte BPE vocabulary read from a `tokenizers` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in ids.items()} | {i: t for t, i in self.specials.items()}
        size = max(self.texts) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pairs: dict[tuple[int, int], int] = {}
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole, a, b = ids[a + b], ids[a], ids[b]
            self.pairs.setdefault((a, b), n)
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = n, a, b
        self.automaton = ahocorasick.Automaton()
        made = {t for t, i in ids.items() if self.rank[i] >= 0}
        for token, i in ids.items():
            core = token.removesuffix(self.suffix) if self.suffix else token
            closed = core != token
            if token in made or len(core) == 1:
                self.automaton.add_word(core + END * closed, (i, len(core) + closed))
        self.automaton.make_automaton()
        self.symbols = byte_symbols()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.faster = FASTER if pattern == PATTERN else self.words
        self.earlier = regex.compile(EARLIER, regex.V1) if pattern == PATTERN else self.words
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.known: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the text of `a` then `b` leaves the border between them.

        Goes back in time from the finished tokens: the later of the two merges
        that made the pieces at the border is undone, and a merge across the
        border counts if it comes before the merges that took its pieces away.
        Of equal merges the left one comes first.
        """
        x, y, gone_x, gone_y = a, b, len(self.pairs) + 1, len(self.pairs) + 1
        rank, pairs = self.rank, self.pairs
        while True:
            across = pairs.get((x, y))
            if across is not None and across < gone_x and across <= gone_y:
                return False
            if rank[x] < 0 and rank[y] < 0:
                return True
            if rank[y] >= rank[x]:
                gone_y, y = rank[y], self.left[y]
            else:
                gone_x, x = rank[x], self.right[x]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (a match of the splitting pattern)."""
        symbols = word if word.isascii() and word.isalnum() else "".join([self.symbols[b] for b in word.encode("utf-8")])
        text = symbols + END if self.suffix else symbols
        last: list[tuple[int, int] | None] = [None] * (len(text) + 1)
        known = self.known
        for at, found in self.automaton.iter(text):
            at += 1
            if last[at] is not None:
                continue
            token, length = found
            start = at - length
            if start:
                before = last[start]
                if before is None:
                    continue
                key = before[0] << 32 | token
                fits = known.get(key)
                if fits is None:
                    if len(known) > REMEMBERED:
                        known.clear()
                    fits = known[key] = self.compatible(before[0], token)
                if not fits:
                    continue
            last[at] = found
        ids, at = [], len(text)
        while at:
            token, length = last[at]
            ids.append(token)
            at -= length
        return ids[::-1]

    def normal(self, text: str) -> str:
        """NFC, then each character lowered by itself (a final sigma too)."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")
            # Every rare character is an unusual one, and the search for these is ten times as fast.
            if UNUSUAL.search(text) and RARE.search(text):
                text = text.translate(_LOWERED)
        return text.lower()

    def split(self, text: str) -> list[str]:
        text = self.normal(text)
        if not UNUSUAL.search(text):
            return self.faster.findall(text)
        return (self.earlier if RARE.search(text) else self.words).findall(text)


class _Words(dict):
    """word -> its packed ids, and their token texts joined by spaces, in UTF-8.

    Holds what was made or asked for lately: a full generation becomes the old one, and what is asked for again goes back to the young one.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}

    def make(self, ids: list[int]) -> tuple[bytes, bytes]:
        texts = self.vocabulary.texts
        return b"".join([i.to_bytes(4, "little") for i in ids]), " ".join([texts.get(i, "") for i in ids]).encode("utf-8")

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        made = self.old.get(word)
        if made is None:
            made = self.make(self.vocabulary.encode_word(word))
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = made
        return made


class Codec:
    """Whole texts to packed ids (unsigned 32-bit, little-endian) and to decoded texts."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.words = _Words(self.vocabulary)

    def parts(self, text: str) -> list[bytes]:
        """Packed ids of each word and each special token of a text."""
        return [ids for ids, _ in self.pairs(text)]

    def pairs(self, text: str) -> list[tuple[bytes, bytes]]:
        """Packed ids, and the text they decode to, of each word and each special token of a text."""
        v = self.vocabulary
        if v.cut and any(s in text for s in v.specials):
            out: list[tuple[bytes, bytes]] = []
            for piece in v.cut.split(text):
                if piece in v.specials:
                    out.append(self.words.make([v.specials[piece]]))
                else:
                    out.extend(map(self.words.__getitem__, v.split(piece)))
            return out
        return list(map(self.words.__getitem__, v.split(text)))

    def both(self, texts: list[str]) -> list[pa.Array]:
        ids, decoded = [], []
        for text in texts:
            pairs = self.pairs(text)
            ids.append(b"".join([x for x, _ in pairs]))
            decoded.append(b" ".join([x for _, x in pairs]))
        return [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())]

    def decode(self, packed: bytes | None) -> str | None:
        """Token texts joined by spaces, as the library does where a file names no
        decoder. Ids that the vocabulary lacks are left out."""
        if packed is None:
            return None
        texts = self.vocabulary.texts
        return " ".join([texts[i] for i in memoryview(packed).cast("I") if i in texts])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for a worker process, which Spark reuses from task to task."""
    return Codec(path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "token_ids", decoded: str = "decoded_text") -> DataFrame:
    """`df` with the packed ids of every whole text and the text they decode to.

    path: the vocabulary file, readable on every worker. A null or empty text
    has no tokens (empty binary, empty string). Special tokens written out in a
    text become their ids. Rows, also repeated ones, and other columns are kept;
    a column named as an output is replaced. An empty table gives an empty one.
    """
    path = path or vocabulary_path()
    outputs = [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())]

    def make():
        remember_alone("bpe", codec.cache_clear)
        return codec(path).both

    return map_texts(df, make, outputs, text)


def decode(df: DataFrame, path: str | None = None, ids: str = "token_ids", out: str = "decoded_text") -> DataFrame:
    """`df` with the text of packed ids (null for null). See `Codec.decode`."""
    path = path or vocabulary_path()

    @F.pandas_udf(T.StringType())
    def run(packed):
        return packed.map(codec(path).decode)

    return df.withColumn(out, run(F.col(ids)))


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token count and digests of ids and decoded text for each document."""
    made = encode(docs.select("doc_id", "text"), path, decoded="text")
    return made.select("doc_id", n_tokens(F.col("token_ids")).alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
