"""Byte-level BPE: encoding with offsets and decoding, with the tokenizers library over Arrow batches.

The vocabulary comes as a file of byte strings and ranks.  A fixed table gives every byte a visible character, so the
library's BPE model works on characters; its merges are all splits of a token into two tokens, in the order of ranks,
and a piece that is a token itself stays whole.  The pattern cuts a text into pieces before.

Texts are cut at places that no piece of the pattern goes over (``unit_starts``), so each unit encodes alike wherever
it stands.  Arrow's dictionary encoding numbers the units that a worker keeps (about ``CACHED_UNITS``, and ``CACHED_BYTES``
of text) and then those of a few slices, so that the units kept are hashed once for all of these; the library encodes the
new ones, and the ids of all units are gathered by index, slice by slice.  When there are too many, the most frequent
half stays.

Decoding joins the tokens' bytes.  A character whose bytes lie in several tokens belongs, by its offsets, to each of
them; its bytes meet again when the whole text is joined.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_UNITS = 250_000
CACHED_BYTES = 16 << 20
#: Texts encoded together; bounds what a worker holds beside its batch.
SLICE_BYTES = 1 << 20
#: Slices whose units are numbered together; until their ids are gathered, a unit takes 8 bytes.
SLICES_TOGETHER = 4
#: New units that the library encodes together: its results take far more room than ids.
LEARNT_UNITS = 8192


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is visible, else the next one from code point 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer_of_ranks(ranks: dict[bytes, int], pattern: str):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = byte_characters()
    name = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = []
    for token, rank in ranks.items():
        for at in range(1, len(token)):
            left, right = token[:at], token[at:]
            if left in ranks and right in ranks:
                merges.append((rank, ranks[left], ranks[right], name[left], name[right]))
    merges.sort()
    model = models.BPE({name[t]: r for t, r in ranks.items()}, [m[3:] for m in merges], ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return tokenizer


def _classes() -> np.ndarray:
    """By byte: bit 1 for an ASCII letter, bit 2 for a byte that white space may contain or begin with."""
    kind = np.zeros(256, np.uint8)
    kind[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] |= 1
    kind[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] |= 2
    return kind


_KIND = _classes()


def unit_starts(raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Places where units begin in the UTF-8 bytes of adjoining texts that begin at ``texts``.

    Before a lone space between non-spaces, around a lone line end between non-spaces, and where a Latin letter meets
    an ASCII character that is neither letter nor space.  No piece of the pattern goes over such a place, and none
    looks beyond it.  Wherever a neighbour may be white space of another kind, nothing is cut.
    """
    kind = _KIND[raw]
    n = len(raw)
    latin = np.zeros(n, bool)  # last byte of a letter U+00C0 to U+00FF
    latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    letter = ((kind & 1) > 0) | latin
    space = (kind & 2) > 0
    wide = (raw >= 0xC2) & space
    unsafe = space.copy()  # last byte of what may be white space
    unsafe[1:] |= wide[:-1]
    unsafe[2:] |= wide[:-2]
    edge = np.zeros(n + 1, bool)
    edge[texts] = True
    first = edge[:n].copy()
    solid = np.zeros(n, bool)  # between two bytes that are no space
    solid[1:-1] = ~unsafe[:-2] & ~space[2:] & ~first[1:-1] & ~first[2:]
    gap = solid & (raw == 0x20)
    line = solid & (raw == 0x0A)
    edge[:n] |= gap | line
    edge[1:n] |= line[:-1]
    edge[1:n] |= letter[:-1] & (raw[1:] < 0x80) & (kind[1:] == 0)
    return np.flatnonzero(edge[:n])


def sure_words(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which parts of UTF-8 bytes, one byte between two of them, are ASCII or Latin letters, with or without a space before."""
    letter = (_KIND[raw] & 1) > 0
    latin = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    letter[1:] |= latin
    letter[:-1] |= latin
    spaced = raw[begins] == 0x20
    letter[begins[spaced]] = True
    letter[(begins + sizes)[:-1]] = True
    sure = ~spaced | (sizes > 1)
    sure[np.searchsorted(begins, np.flatnonzero(~letter), "right") - 1] = False
    return sure


def runs(values: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts`` values from each of the places ``begins`` on, in a row."""
    stops = np.cumsum(counts)
    return values[np.repeat(begins - (stops - counts), counts) + np.arange(stops[-1] if len(stops) else 0)]


class UnitEncoder:
    """Encodes texts unit by unit, each distinct unit of a slice once at most; ids are unsigned 32-bit integers.

    With ``words_whole`` the tokenizer's pattern takes letters, with or without a space before them, as one piece; such
    units go to its merges directly.  The text of a token added to the tokenizer is ordinary text, or with ``added_tokens`` that token, as by the library's
    default.  It is a unit then: the library encodes what lies before and behind it on its own.
    """

    def __init__(self, tokenizer, byte_lengths: np.ndarray, added_tokens: bool = False, words_whole: bool = False):
        self.tokenizer = tokenizer
        self.words_whole = words_whole
        self.lengths = byte_lengths
        self.characters = np.array([*map(ord, byte_characters())], "<u4")
        self.characters[0x0A] = 0x0A  # no word holds a line end
        # The units kept, how often they came, how many ids each has, and these ids in a row.
        self.known = pa.array([], pa.binary())
        self.uses, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.added: re.Pattern[bytes] | None = None
        if not added_tokens:
            self.tokenizer.encode_special_tokens = True
        elif added := self.tokenizer.get_added_tokens_decoder().values():
            if tokenizer.normalizer or any(t.single_word or t.lstrip or t.rstrip for t in added):
                raise ValueError("added tokens that depend on the text around them, or on a normalizer")
            contents = sorted((t.content.encode() for t in added), key=len, reverse=True)
            self.added = re.compile(b"|".join(map(re.escape, contents)))

    def _around_added(self, raw: np.ndarray, texts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The places where units begin, with every added token's text as a unit; ``texts`` has the end, too."""
        held = raw.tobytes()
        if not self.added or not self.added.search(held):
            return starts
        ends = texts.tolist()
        spans = np.array([m.span() for b, e in zip(ends, ends[1:]) for m in self.added.finditer(held, b, e)], np.int64).reshape(-1, 2)
        if not len(spans):
            return starts
        before = np.searchsorted(spans[:, 0], starts) - 1  # the last token's text that begins before
        inside = (before >= 0) & (starts < spans[before, 1])
        places = np.concatenate([starts[~inside], spans.ravel()])
        return np.unique(places[places < len(raw)])

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joint(self, units: list[bytes], between: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of units that go as one text, where each unit's begin, and how many they are."""
        ids = self._whole([between.join(units).decode()])[0]
        sizes = np.fromiter(map(len, units), np.int64, len(units)) + len(between)
        # Tokens until each unit's last byte; a line end is a token of its own.
        cuts = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes) - len(between)) + 1
        begins = np.concatenate([[0], cuts[:-1] + len(between)])
        return ids, begins, cuts - begins

    def _singly(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of units that go one by one."""
        own = self._whole([raw.decode() for raw in units])
        counts = np.fromiter(map(len, own), np.int64, len(own))
        return np.concatenate(own), np.cumsum(counts) - counts, counts

    def _words(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of words, by the model alone, without the pattern."""
        shown = self.characters[np.frombuffer(b"\n".join(units), np.uint8)].tobytes().decode("utf-32-le")
        merged, ids, stops = self.tokenizer.model.tokenize, array("I"), array("q", [0])
        for word in shown.split("\n"):  # one at a time: many of the library's tokens held together cost more
            ids.extend([token.id for token in merged(word)])
            stops.append(len(ids))
        places = np.frombuffer(stops, np.int64)
        return np.frombuffer(ids, np.uint32), places[:-1], np.diff(places)

    def _learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each new unit has, and these in a row.

        Words after a space go as one text, other words as lines of one text, the rest singly.
        """
        joint = b"\n".join(units)
        raw, sizes = np.frombuffer(joint, np.uint8), np.fromiter(map(len, units), np.int64, len(units))
        begins = np.cumsum(sizes + 1) - sizes - 1
        words = sure_words(raw, begins, sizes)
        spaced = words & (raw[begins] == 0x20)
        odd = ~words if not self.added or not self.added.search(joint) else np.ones(len(units), bool)
        for at in np.flatnonzero(odd).tolist():
            text = units[at].decode()
            words[at] = text[text[0] == " " :].isalpha() and not (self.added and self.added.search(units[at]))
            spaced[at] = words[at] and text[0] == " "
        found, total, begins, counts = [], 0, np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        kinds = [(words, self._words)] if self.words_whole else [
            (spaced, lambda own: self._joint(own, b"")), (words & ~spaced, lambda own: self._joint(own, b"\n"))
        ]
        for kind, encode in (*kinds, (~words, self._singly)):
            places = np.flatnonzero(kind)
            if len(places):
                ids, at, counts[places] = encode([units[k] for k in places.tolist()])
                begins[places] = at + total
                found.append(ids)
                total += len(ids)
        return counts, runs(np.concatenate(found), begins, counts)

    def _forget(self) -> None:
        """Keep the most frequent units, up to half of both limits; their uses so far count half from now on."""
        order = np.argsort(-self.uses, kind="stable")[: CACHED_UNITS // 2]
        held = np.cumsum(np.asarray(pc.binary_length(self.known)).astype(np.int64)[order])
        keep = np.sort(order[held <= CACHED_BYTES // 2])
        ids = np.zeros(len(self.counts), bool)
        ids[keep] = True
        self.flat = self.flat[np.repeat(ids, self.counts)]
        self.known, self.uses, self.counts = self.known.take(pa.array(keep)), self.uses[keep] // 2, self.counts[keep]

    def _units(self, texts: pa.LargeBinaryArray) -> tuple[pa.BinaryArray, np.ndarray]:
        """The units of all texts, and how many there are until each text's end."""
        _, offsets, data = texts.buffers()
        if not len(texts) or not data:
            return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(raw):
            return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
        starts = self._around_added(raw, offsets, unit_starts(raw, offsets))
        bounds = np.append(starts, len(raw)).astype(np.int32)
        units = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
        return units, np.searchsorted(starts, offsets[1:])

    def encode(self, texts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the place at which each text (as UTF-8) ends."""
        return next(self.encode_slices([texts]))

    def encode_slices(self, slices: Sequence[pa.LargeBinaryArray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for each of a few slices, which are cut into units and numbered together."""
        if len(self.known) > CACHED_UNITS or self.known.nbytes > CACHED_BYTES:
            self._forget()
        parts = [self._units(texts) for texts in slices]
        coded = pa.chunked_array([self.known, *(units for units, _ in parts)]).dictionary_encode()
        indices = np.concatenate([c.indices for c in coded.chunks])[len(self.known) :]
        known = coded.chunks[-1].dictionary
        if len(new := known[len(self.known) :]):
            learnt = [self._learn(new.slice(at, LEARNT_UNITS).to_pylist()) for at in range(0, len(new), LEARNT_UNITS)]
            self.counts = np.concatenate([self.counts, *(counts for counts, _ in learnt)])
            self.flat = np.concatenate([self.flat, *(ids for _, ids in learnt)])
            self.known = known
        uses = np.bincount(indices, minlength=len(self.known))
        uses[: len(self.uses)] += self.uses
        self.uses, counts, flat = uses, self.counts, self.flat
        places = np.cumsum(counts) - counts
        begin = 0
        for units, ends in parts:
            at = indices[begin : begin + len(units)]
            begin += len(units)
            n = counts[at]
            yield runs(flat, places[at], n), np.concatenate([[0], np.cumsum(n)])[ends]


@lru_cache(maxsize=2)
def rank_codec(path: str, pattern: str) -> tuple[UnitEncoder, list[bytes], list[str]]:
    """Per worker: the encoder, the bytes of each id, and the ids in decimal."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    encoder = UnitEncoder(tokenizer_of_ranks(ranks, pattern), np.array([len(t) for t in table]))
    return encoder, table, [str(i) for i in range(len(table))]


def slices(texts: pa.LargeBinaryArray) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with about ``SLICE_BYTES`` bytes each."""
    held = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    begin = 0
    while begin < len(texts):
        before = held[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(held, before + SLICE_BYTES, "right")))
        yield begin, end
        begin = end


def encoded_batches(batch: pa.RecordBatch, encoder: UnitEncoder) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch with the ids of each row's text; null counts as empty."""
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "").cast(pa.large_binary())
    for ranges in batched(slices(texts), SLICES_TOGETHER):
        encoded = encoder.encode_slices([texts.slice(begin, end - begin) for begin, end in ranges])
        for (begin, end), (ids, stops) in zip(ranges, encoded):
            yield batch.slice(begin, end - begin), np.split(ids, stops[:-1])


def offsets(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points that each token covers, end exclusive; a character split over tokens counts for each of them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32) - 1
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    return character[starts], character[ends - 1] + 1


def encode(docs: DataFrame, path: str, pattern: str, with_offsets: bool = True) -> DataFrame:
    """doc_id, ids and, if wanted, starts and ends (code points) of every row of ``docs``.

    A null or empty text has no ids.  No special tokens are made.  Other columns than doc_id and text are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "ids", "starts", "ends"] if with_offsets else ["doc_id", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_codec(path, pattern)[0]
        for batch in batches:
            for rows, ids in encoded_batches(batch, encoder):
                columns = [rows.column("doc_id"), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))]
                if with_offsets:
                    spans = [offsets(t or "", i, encoder.lengths) for t, i in zip(rows.column("text").to_pylist(), ids)]
                    columns += [pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} array<int>" for n in names[1:]))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, raw (the bytes of the ids) and text (these as UTF-8; bytes that are none become U+FFFD)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, _ = rank_codec(path, pattern)
        for batch in batches:
            raw = [b"".join(map(table.__getitem__, ids or ())) for ids in batch.column("ids").to_pylist()]
            columns = [batch.column("doc_id"), pa.array(raw, pa.binary()), pa.array([r.decode(errors="replace") for r in raw], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "raw", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, raw binary, text string")


def round_trips(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256 (of the decoded bytes).

    Encodes and decodes in one pass, so that neither ids nor texts leave the worker.  Null counts as empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table, decimal = rank_codec(path, pattern)
        hexed: Callable[[bytes], str] = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            for rows, encoded in encoded_batches(batch, encoder):
                counts, listed, decoded = [], [], []
                for own in encoded:
                    ids = own.tolist()
                    counts.append(len(ids))
                    listed.append(hexed(",".join(map(decimal.__getitem__, ids)).encode()))
                    decoded.append(hexed(b"".join(map(table.__getitem__, ids))))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", F.col("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
