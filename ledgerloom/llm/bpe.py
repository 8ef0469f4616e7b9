"""BPE encoding with content-defined chunks that documents share.

A rolling hash of the last ``WINDOW`` code points decides where a text is cut, so equal passages are cut
alike wherever they stand. Chunks that occur more than once, in one text or many, are encoded once, in a
table of their own; what lies between them occurs once and is encoded in its place. Where two pieces meet,
the text around the join is encoded anew and replaces the pieces' own ids there; it must agree with both
pieces on the segment beyond, else it is widened, to the whole of both pieces and to further ones.

Equal texts are one row until the result is joined back. Texts cross the network once, compressed; beside them go a
digest a chunk, and the ids of shared chunks to the texts that hold them.

A segment reaches from one white space to the next. The tokenizer drops white space and no match of its
pattern, no added token and no normalisation of a character reaches across one, so ids of segments can be
told apart by their number.

Words of Latin letters are looked up in a table of words, which holds what the tokenizer made of them; all
else goes to the tokenizer as it is.

Defined results: null texts count as empty; an empty text has no ids; repeated rows stay; an empty table
gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut, small, spread

#: Code points that decide on a cut; a power of two.
WINDOW = 16
@dataclass(frozen=True)
class Sizes:
    """Code points of a chunk, but for the last of a text; a cut is made after one in ``spacing`` places of those allowed."""

    least: int = 128
    spacing: int = 1024
    most: int = 8192


SIZES = Sizes()
#: Words that a task remembers; then it begins anew.
WORDS = 1 << 18
#: Names of texts whose chunks are encoded for others (about 100 bytes each), broadcast to the scan up to this number.
MAX_BROADCAST_OWNERS = 500_000
_FACTOR = np.uint32(0x9E3779B1)
_SPACE = re.compile(r"[ \t\n\r]")
#: Characters that normal form C leaves alone, but for the capital I with a dot, whose lower case has a mark.
_PLAIN = re.compile("[\x00-įı-ſ]*")
#: What the tokenizer's pattern matches, spelt out for those characters.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\t-\\r \x85\xa0{_LETTERS}{_DIGITS}]+")

Ids = list[int]


class Encoder:
    """Ids of texts, as the tokenizer of a file gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[str, Ids] = {}
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.names = {i: name for name, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.decimals = {i: str(i) for i in self.names}

    def whole(self, text: str) -> Ids:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> Ids:
        if not _PLAIN.fullmatch(text) or any(a in text for a in self.added):
            return self.whole(text)
        found, known = _WORD.findall(text.lower()), self.words
        if new := set(found).difference(known):
            if len(known) > WORDS:
                known.clear()
                new = set(found)
            self.learn(sorted(new))
        return list(chain.from_iterable(map(known.__getitem__, found)))

    def learn(self, words: list[str]) -> None:
        """Encodes words in one call; white space keeps them apart."""
        done = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, starts = done.ids, np.searchsorted(np.array(done.word_ids, np.int64), np.arange(len(words) + 1)).tolist()
        self.words.update((w, ids[a:b]) for w, (a, b) in zip(words, pairwise(starts), strict=True))

    def listed(self, ids: Ids) -> str:
        """Ids in decimal, joined by a space."""
        return " ".join(map(self.decimals.__getitem__, ids))

    def decode(self, ids: Ids) -> str:
        return " ".join(filter(None, map(self.names.get, ids)))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def ends(text: str, sizes: Sizes = SIZES) -> list[int]:
    """Where the chunks of a text end."""
    n = len(text)
    if n <= sizes.least:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le"), np.uint32) * np.uint32(2654435761) + np.uint32(1)
    step, power = 1, _FACTOR
    while step < WINDOW:
        wider = h.copy()
        wider[step:] += h[:-step] * power
        h, step, power = wider, 2 * step, np.uint32(int(power) ** 2 & 0xFFFFFFFF)
    # the upper bits depend on all code points of the window
    marks = (np.flatnonzero(h >> np.uint32(12) < np.uint32((1 << 20) // sizes.spacing)) + 1).tolist()
    out, last, k = [], 0, 0
    while n - last > sizes.least:
        while k < len(marks) and marks[k] < last + sizes.least:
            k += 1
        end = min(marks[k] if k < len(marks) else n, last + sizes.most, n)
        out.append(end)
        last = end
    if last < n:
        out.append(n)
    return out


def digest(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode("utf-8"), digest_size=16).digest()


def outer(chunk: str) -> tuple[int, int, int, int] | None:
    """The ends of the first two segments and the starts of the last two; None if those are not four."""
    first = _SPACE.search(chunk, 1)
    second = first and _SPACE.search(chunk, first.start() + 1)
    if not second:
        return None
    last = max(chunk.rfind(c) for c in " \t\n\r")
    before = max(chunk.rfind(c, 0, last) for c in " \t\n\r")
    return (first.start(), second.start(), before, last) if before > second.start() else None


@dataclass
class Piece:
    """A stretch of a text with its ids; ``counts`` are those of its first, second, last but one and last segment."""

    start: int
    end: int
    ids: Ids | None = None
    counts: list[int] | None = None

    def encode(self, encode: Callable[[str], Ids], text: str) -> Piece:
        if self.ids is None:
            self.ids, self.counts = encoded(encode, text[self.start : self.end])
        return self


def encoded(encode: Callable[[str], Ids], chunk: str) -> tuple[Ids, list[int] | None]:
    """Ids of a chunk, and how many are of its outer segments; None if it has too few segments."""
    at = outer(chunk)
    if at is None:
        return encode(chunk), None
    parts = [encode(chunk[a:b]) for a, b in pairwise((0, *at, len(chunk)))]
    return [i for p in parts for i in p], [len(parts[k]) for k in (0, 1, 3, 4)]


def pieces_of(encode: Callable[[str], Ids], text: str, cuts: list[int], shared: dict[int, tuple[Ids, list[int] | None]]) -> list[Piece]:
    """Shared chunks as they are, stretches between them encoded here; those with too few segments join their neighbours."""
    out: list[Piece] = []
    for k, (start, end) in enumerate(pairwise((0, *cuts))):
        if k in shared:
            out.append(Piece(start, end, *shared[k]))
        elif out and out[-1].ids is None:
            out[-1].end = end
        else:
            out.append(Piece(start, end))
    joined: list[Piece] = []
    weak = False
    for p in out:
        p.encode(encode, text)
        if joined and (weak or p.counts is None):
            joined[-1] = Piece(joined[-1].start, p.end)
        else:
            joined.append(p)
        weak = p.counts is None
    return [p.encode(encode, text) for p in joined]


def assembled(encode: Callable[[str], Ids], text: str, cuts: list[int], shared: dict[int, tuple[Ids, list[int] | None]]) -> Ids:
    """Ids of a text, given those of its shared chunks by place."""
    pieces = pieces_of(encode, text, cuts, shared) if shared else [Piece(0, len(text)).encode(encode, text)]
    ids = list(pieces[0].ids)
    for left, right in pairwise(pieces):
        *_, inner, last = left.counts
        first, second, *_ = right.counts
        start = left.start + outer(text[left.start : left.end])[2]
        end = right.start + outer(text[right.start : right.end])[1]
        around = encode(text[start:end])
        at = len(ids) - last - inner
        if around[:inner] != ids[at : at + inner] or around[len(around) - second :] != right.ids[first : first + second]:
            return encode(text)
        ids[at:] = around + right.ids[first + second :]
    return ids


def _key(text: Column) -> Column:
    """128 bits of the text's SHA-256; never null, so that no filter sets plans apart that share an exchange."""
    return F.coalesce(F.unhex(F.left(F.sha2(text, 256), F.lit(32))), F.lit(b""))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.record_batch([batch["h"], pa.array([pack(t.encode()) for t in batch["text"].to_pylist()], pa.binary())], ["h", "packed"])


def _texts(packed: pa.Array) -> list[str]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(z).decode() for z in packed.to_pylist()]


def _chunk_digests(sizes: Sizes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, digests = [], [], []
            for h, text in zip(batch["h"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for k, (a, b) in enumerate(pairwise((0, *ends(text, sizes)))):
                    keys.append(h)
                    places.append(k)
                    digests.append(digest(text[a:b]))
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(places, pa.int32()), pa.array(digests, pa.binary())], ["h", "place", "c"])

    return run


def _encode_chunks(path: str, sizes: Sizes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            digests, ids, counts = [], [], []
            for text, owned in zip(batch["text"].to_pylist(), batch["owned"].to_pylist(), strict=True):
                spans = list(pairwise((0, *ends(text, sizes))))
                for o in owned:
                    a, b = spans[o["place"]]
                    own, outers = encoded(encode, text[a:b])
                    digests.append(o["c"])
                    ids.append(own)
                    counts.append(outers)
            whole = pa.list_(pa.int32())
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(ids, whole), pa.array(counts, whole)], ["c", "ids", "counts"])

    return run


def _ids_column(encode: Encoder, rows: list[Ids]) -> dict[str, pa.Array]:
    return {"ids": pa.array(rows, pa.list_(pa.int32()))}


def _description(encode: Encoder, rows: list[Ids]) -> dict[str, pa.Array]:
    sha = lambda text: hashlib.sha256(text.encode()).digest()
    return {
        "n_tokens": pa.array([len(ids) for ids in rows], pa.int64()),
        "ids_sha256": pa.array([sha(encode.listed(ids)) for ids in rows], pa.binary()),
        "decoded_sha256": pa.array([sha(encode.decode(ids)) for ids in rows], pa.binary()),
    }


def _assemble(path: str, columns: Callable[[Encoder, list[Ids]], dict[str, pa.Array]], sizes: Sizes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for text, have in zip(_texts(batch["packed"]), batch["have"].to_pylist(), strict=True):
                shared = {s["place"]: (s["ids"], s["counts"]) for s in have or ()}
                rows.append(assembled(encode, text, ends(text, sizes) if shared else [], shared))
            made = columns(encode, rows)
            yield pa.record_batch([batch["h"], *made.values()], ["h", *made])

    return run


def shared_chunks(texts: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """(h, place, c, owned): the chunks that occur more than once in (h, text); one occurrence of each is ``owned``."""
    digests = cut(texts.mapInArrow(_chunk_digests(sizes), "h binary, place int, c binary").distinct())
    counted = digests.groupBy("c").agg(F.count("*").alias("n"), F.min(F.struct("h", "place")).alias("owner"))
    shared = spread(counted.where("n > 1").select("c", "owner"))
    return cut(digests.join(shared, "c").select("h", "place", "c", (F.col("owner") == F.struct("h", "place")).alias("owned")))


def _encoded_texts(texts: DataFrame, path: str, columns: Callable[[Encoder, list[Ids]], dict[str, pa.Array]], schema: str, sizes: Sizes) -> DataFrame:
    shared = shared_chunks(texts, sizes)
    owned = cut(shared.where("owned").groupBy("h").agg(F.collect_list(F.struct("place", "c")).alias("owned")))
    owners = texts.join(small(owned, MAX_BROADCAST_OWNERS), "h").groupBy("h").agg(F.first("text").alias("text"), F.first("owned").alias("owned"))
    chunks = owners.select("text", "owned").mapInArrow(_encode_chunks(path, sizes), "c binary, ids array<int>, counts array<int>")
    once = texts.mapInArrow(_packed, "h binary, packed binary").groupBy("h").agg(F.first("packed").alias("packed"))
    have = shared.join(chunks, "c").groupBy("h").agg(F.collect_list(F.struct("place", "ids", "counts")).alias("have"))
    return once.join(have, "h", "left").mapInArrow(_assemble(path, columns, sizes), f"h binary, {schema}")


def encode_texts(texts: DataFrame, path: str, sizes: Sizes = SIZES) -> DataFrame:
    """(h, ids) for each different text of (h, text), where equal texts have equal keys h."""
    return _encoded_texts(texts, path, _ids_column, "ids array<int>", sizes)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text), null texts as empty ones; equal texts have equal keys."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", _key(text).alias("h"), text.alias("text"))


def encode_documents(docs: DataFrame, path: str, sizes: Sizes = SIZES) -> DataFrame:
    """doc_id, ids of all documents."""
    rows = keyed(docs)
    return rows.select("doc_id", "h").join(spread(encode_texts(rows.select("h", "text"), path, sizes)), "h").select("doc_id", "ids")


def describe_documents(docs: DataFrame, path: str, sizes: Sizes = SIZES) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to."""
    rows = keyed(docs)
    done = _encoded_texts(rows.select("h", "text"), path, _description, "n_tokens long, ids_sha256 binary, decoded_sha256 binary", sizes)
    hexed = (F.lower(F.hex(c)).alias(c) for c in ("ids_sha256", "decoded_sha256"))
    return rows.select("doc_id", "h").join(spread(done), "h").select("doc_id", "n_tokens", *hexed)


def decode_documents(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids give a null text, unknown ids are left out as the tokenizer does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            texts = [None if ids is None else encode.decode(ids) for ids in batch["ids"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
