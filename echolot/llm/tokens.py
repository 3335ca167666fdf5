"""Exact token counts and ids from public tokenizers, with one model call for each distinct piece of text.

Byte-level BPE splits a text into pre-tokens, and no pre-token runs across a space that stands between
two characters that are not white space: the space opens the next pre-token. So the stretches between
such spaces (segments) can be tokenized apart, and a segment that occurs again costs a dictionary look-up.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from echolot.llm.arrow import keyed_texts, map_arrow, utf8

#: Entries that a worker's dictionary of segments may hold before it is emptied.
CACHE_ENTRIES = 800_000

_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: White space beside more of it, or any but spaces and line ends.
_SPACES = re.compile(r"\s\s|[^\S \n]")


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as letters: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def single_pretoken(text: str) -> str | None:
    """The pre-token, in byte letters, of Latin letters behind at most one space; None for anything else."""
    body = text[1:] if text[:1] == " " else text
    if body.isascii():
        return text.replace(" ", _BYTE_LETTERS[32]) if body.isalpha() else None
    if body.isalpha() and max(body) < "\u0100":
        return text.encode().decode("latin-1").translate(_BYTE_LETTERS)
    return None


def split_segments(text: str) -> list[str]:
    """Stretches that byte-level BPE can tokenize apart; joined they give the text back."""
    parts = _SINGLE_SPACE.split(text)
    return [parts[0], *(" " + part for part in parts[1:])]


class _Segments(dict):
    """Values of segments as split at every single space, or None where that split isn't a safe one.

    Keys are UTF-8 bytes without the leading space; `lead` says whether the text has one there. A segment
    whose parts are pre-tokens for certain (an ASCII letter before commas or full stops at the end, a
    single line end between other characters) is put together from the values of these parts.
    """

    def __init__(self, evaluate, letters, lead: str, plain: _Segments | None = None) -> None:
        super().__init__()
        self.evaluate, self.letters, self.lead, self.plain = evaluate, letters, lead, self if plain is None else plain
        self.mark, self.line_end = single_pretoken(lead + "a")[:-1], evaluate("\n")

    def __missing__(self, key: bytes):
        if key.isalpha():  # ASCII letters are one pre-token as they are
            value = self[key] = self.letters(self.mark + key.decode())
            return value
        tail = key[-1:]
        if tail in (b",", b".") and key.isascii() and (core := key.rstrip(b",."))[-1:].isalpha():
            value = self[core]
            value = self[key] = value if value is None else value + self.plain[key[len(core) :]]
            return value
        part = key.decode()
        if not part or part[0].isspace() or part[-1].isspace():
            value = self[key] = None
        elif b"\n" in key and not _SPACES.search(part):
            first, *rest = key.split(b"\n")
            value = self[first]
            for line in rest:
                value = value + self.line_end + self.plain[line]
            self[key] = value
        else:
            value = self[key] = self.evaluate(self.lead + part)
        return value


class SegmentReader:
    """Bytes for all segments of a text, from dictionaries of bounded size."""

    def __init__(self, evaluate, letters, entries: int = CACHE_ENTRIES) -> None:
        self.evaluate, self.entries = evaluate, entries
        self.first = _Segments(evaluate, letters, "")
        self.rest = _Segments(evaluate, letters, " ", self.first)

    def joined(self, text: bytes) -> bytes:
        """The values of a text's segments, one after another."""
        if not text:
            return b""
        if len(self.first) + len(self.rest) > self.entries:
            self.first.clear()
            self.rest.clear()
        parts = iter(text.split(b" "))
        found = [self.first[next(parts)]]
        found.extend(map(self.rest.__getitem__, parts))
        try:
            return b"".join(found)
        except TypeError:  # a None for a run of white space: split with care
            return b"".join([self.evaluate(x) for x in split_segments(text.decode())])


class PieceCounter:
    """Token counts of texts: each distinct pre-token is given to the model once."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES) -> None:
        self.tokenizer = load_tokenizer(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, int] = {}
        self.entries = entries
        self.first = _Segments(self.segment, self.piece_count, "")
        self.rest = _Segments(self.segment, self.piece_count, " ", self.first)

    def piece_count(self, pretoken: str) -> int:
        n = self.pieces.get(pretoken)
        if n is None:
            n = self.pieces[pretoken] = len(self.tokenizer.model.tokenize(pretoken))
        return n

    def segment(self, text: str) -> int:
        if any(x in text for x in self.added):  # a special string is one token and cuts the text
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        single = single_pretoken(text)
        pretokens = [single] if single else [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return sum(map(self.piece_count, pretokens))

    def count(self, text: bytes) -> int:
        """Sum of frequency times pieces over the document's distinct segments."""
        if not text:
            return 0
        if len(self.first) + len(self.rest) + len(self.pieces) > 2 * self.entries:
            for cache in (self.first, self.rest, self.pieces):
                cache.clear()
        head, *tail = text.split(b" ")
        total = self.first[head]
        if total is not None:
            rest = self.rest
            for segment, n in Counter(tail).items():
                pieces = rest[segment]
                if pieces is None:
                    break
                total += n * pieces
            else:
                return total
        return sum(n * self.segment(x) for x, n in Counter(split_segments(text.decode())).items())


@lru_cache(maxsize=2)
def _counter(path: str, entries: int) -> PieceCounter:
    return PieceCounter(path, entries)


def token_counts(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 512, entries: int = CACHE_ENTRIES) -> DataFrame:
    """Exact number of tokens of every text, without materialising ids.

    A document becomes a table of distinct segments with frequencies; it is joined to a dictionary of
    piece counts, in which each distinct pre-token is tokenized once per worker, and the products are
    summed. Both sides of that join are partition-local, so nothing is shuffled: sending one row for
    each document and pre-token to a corpus-wide table costs several times the input in shuffle.

    Null text counts as empty (0 tokens). Rows are independent: repeated keys and rows, null keys and
    any further columns are fine, each input row gives one result row. An empty table gives none.
    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).
    """

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path, entries)
        for batch in batches:
            texts = [x or b"" for x in utf8(batch.column(1))]
            counts = [counter.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])], schema=out
            )

    pairs = keyed_texts(docs, key, text)
    kind = pairs.schema["doc_id"].dataType.simpleString()
    return map_arrow(pairs, run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", release=False)


@lru_cache(maxsize=2)
def byte_level_reader(path: str, width: int = 4) -> SegmentReader:
    """Ids of byte-level BPE segments as packed native integers of 2 or 4 bytes."""
    code = {2: "H", 4: "I"}[width]
    tokenizer = load_tokenizer(path)
    encode, model = tokenizer.encode, tokenizer.model.tokenize

    def letters(pretoken: str) -> bytes:
        return array(code, [t.id for t in model(pretoken)]).tobytes()

    def evaluate(text: str) -> bytes:
        single = single_pretoken(text)
        return letters(single) if single else array(code, encode(text, None, False, False).ids).tobytes()

    return SegmentReader(evaluate, letters, 2 * CACHE_ENTRIES)


class WordEncoder(dict):
    """Ids of a BPE whose tokens never cross white space, cached by ASCII-space-separated chunk.

    Its cache lives as long as a task, as packing follows other operators in the same workers.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES) -> None:
        super().__init__()
        self.tokenizer, self.entries = load_tokenizer(path), entries

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk[-1:] in (b",", b".") and chunk.isascii() and (core := chunk.rstrip(b",."))[-1:].isalpha():
            ids = self[chunk] = self[core] + self[chunk[len(core) :]]  # letters and the marks behind them are apart
            return ids
        if chunk.isalpha() and not chunk.islower():  # the tokenizer lower-cases words
            ids = self[chunk] = self[chunk.lower()]
            return ids
        single = chunk.decode() if chunk.isalpha() else single_pretoken(chunk.decode().lower())
        found = [t.id for t in self.tokenizer.model.tokenize(single)] if single else self.tokenizer.encode(chunk.decode(), None, False, False).ids
        ids = self[chunk] = array("I", found).tobytes()
        return ids

    def encode(self, text: bytes | None) -> bytes:
        if len(self) > self.entries:
            self.clear()
        return b"".join(map(self.__getitem__, (text or b"").split()))
