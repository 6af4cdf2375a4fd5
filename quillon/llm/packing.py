"""Packing of tokenised documents into sequences by vector best-fit.

A document is its token ids and an end id; longer ones are cut into pieces.  A piece has three needs: tokens, one document,
and attention cost (the square of its length).  Pieces are taken from the longest on; each goes to the open sequence that
is best by a score over all three residual capacities, the residual norm or the weighted dot-product, among those that
hold it in every one of them; where there is none, a sequence is opened.

Pieces are dealt out evenly, a bounded number to a task, whatever their document or source, and packed there: a task's
last few sequences are all that is lost against packing at one place.  Sequence numbers carry the task's number.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillon.llm.common import stored


@dataclass(frozen=True)
class PackSettings:
    tokens: int = 2048  # of a sequence
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)  # of tokens, documents, attention, each as a share of its capacity
    score: str = "norm"  # or "dot"
    pieces_per_task: int = 20_000


#: Words whose ids a worker keeps; two generations of them, so memory is bounded and frequent words stay.
KEPT_WORDS = 320_000
LONGEST = 64  # bytes of a word that is kept
PART_BYTES = 2 << 20  # of texts that are split into words at a time
CALL_WORDS = 4000  # that are tokenised in one call
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
ACCENTED = bytes(c - 0x40 for c in range(0xC0, 0x100) if c not in b"\xd7\xf7")  # after C3, letters from U+00C0 to U+00FF
#: Words of a-z, A-Z and those letters.
PLAIN = re.compile(rb"(?:[a-zA-Z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
LETTER, HALF, MARK = 1, 2, 3
KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in ((LETTER, LETTERS), (HALF, ACCENTED), (MARK, MARKS)):
    KINDS[list(_bytes)] = _kind
LAST_BLANK = re.compile(rb".*[ \t\n\x0b\x0c\r]", re.S)
FIRST_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")
_tokenizers: dict[str, "WordTokenizer"] = {}


class WordTokenizer(dict):
    """Token ids by words between ASCII white space, which the tokenizer drops and never joins across; so a text's ids
    are its words' ids in their order, and a word need be tokenised but once.  The dictionary is of the words' ids.

    Texts are worked on some megabytes at a time: Arrow numbers their words, each different one is looked up once, and the
    unknown plain ones are tokenised thousands in a call.

    The tokenizer lower-cases, and parts a mark from the letter or digit before it; so texts are taken in lower case and cut
    there, too.  Texts that may hold special tokens, which are told by case, are taken as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict[bytes, bytes] = {}
        # the model alone, for plain words: each is one unit, and only case and spelling are to be normalised, byte by byte
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.spelled = np.arange(256, dtype="<u2")
        self.spelled[65:91] += 32
        for c in ACCENTED:
            self.spelled[[0xC3, c]] = list(map(ord, self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c + 0x40).lower())[0][0]))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a unit
        self.ends[[i for x, i in vocabulary.items() if x.endswith(self.tokenizer.model.end_of_word_suffix)]] = True

    def ids(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null one is empty.  A long text is worked on in parts."""
        group, size = [], 0
        for text in texts:
            text = text or b""
            if group and size + len(text) > PART_BYTES:
                yield from self._ids_of(group)
                group, size = [], 0
            if len(text) > PART_BYTES:
                yield b"".join(x for part in parts_of(text) for x in self._ids_of([part]))
            else:
                group.append(text)
                size += len(text) + 1
        if group:
            yield from self._ids_of(group)

    def _ids_of(self, texts: list[bytes]) -> list[bytes]:
        split = split_words(texts)
        words = split.flatten().dictionary_encode()
        found = self._found(words.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        at, size = words.indices.to_numpy(), np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin, each = np.cumsum(size) - size, size[at]
        place = np.concatenate([[0], np.cumsum(each)])
        take = np.repeat(begin[at] - place[:-1], each)
        take += np.arange(place[-1])
        ids = np.frombuffer(b"".join(found), "<u4")[take]
        cuts = place[split.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _found(self, words: list[bytes]) -> list[bytes]:
        """The ids of words that differ from each other."""
        found, new = list(map(self.get, words)), []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            w = words[i]
            if w not in self.old and len(w) <= LONGEST and (w.isalpha() or PLAIN(w)):
                new.append(i)
            else:
                found[i] = self[w]
        for k in range(0, len(new), CALL_WORDS):
            some = new[k : k + CALL_WORDS]
            text = self.spelled[np.frombuffer(b" ".join([words[i] for i in some]), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts, whole = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()], ids.tobytes()
            for i, a, b in zip(some, cuts[:-1], cuts[1:], strict=True):
                found[i] = whole[a:b]
                self._keep(words[i], found[i])
        return found

    def _keep(self, w: bytes, ids: bytes) -> None:
        if len(self) >= KEPT_WORDS:
            self.old = dict(self)
            self.clear()
        self[w] = ids

    def __missing__(self, w: bytes) -> bytes:
        ids = self.old.get(w)
        if ids is None:
            ids = pack_ids(self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids)
        if len(w) <= LONGEST:
            self._keep(w, ids)
        return ids


def split_words(texts: list[bytes]) -> pa.ListArray:
    """The words of each text, some of them empty, in lower case (a-z alone) and cut before marks that follow a letter or
    digit; both not in texts that may hold special tokens."""
    special = [b"<|" in x for x in texts]
    text = np.frombuffer(b" ".join([*(x if s else x.lower() for x, s in zip(texts, special, strict=True)), b""]), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    kinds = KINDS[text]
    for i in np.flatnonzero(special):
        kinds[ends[i] : ends[i + 1]] = 0
    cuts = np.flatnonzero((kinds[1:] == MARK) & (kinds[:-1] % MARK > 0)) + 1
    cuts = cuts[(kinds[cuts - 1] == LETTER) | (text[cuts - 2] == 0xC3)]
    whole = np.full(len(text) + len(cuts), 32, np.uint8)
    kept = np.ones(len(whole), bool)
    kept[cuts + np.arange(len(cuts))] = False
    whole[kept] = text
    ends += np.searchsorted(cuts, ends)
    return pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(whole)))


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def parts_of(text: bytes) -> Iterator[bytes]:
    """A text cut after white space into parts of so many bytes, or of one word."""
    at = 0
    while at < len(text):
        cut = LAST_BLANK.match(text, at, at + PART_BYTES) if len(text) - at > PART_BYTES else None
        if cut is None:
            cut = FIRST_BLANK.search(text, min(len(text), at + PART_BYTES))
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def tokenizer_at(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, settings: PackSettings = PackSettings(), end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document; a null text is empty and has its end id alone.

    Every row of docs is a document of its own, repeated rows and null ids too.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids

    end, most = np.array([end_id], "<u4").tobytes(), 4 * settings.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(path)
        for batch in batches:
            ids, rows, place, size = batch.column("doc_id"), [], [], 0
            texts = batch.column("text").cast(pa.large_binary())
            for i, got in enumerate(tokenizer.ids(x.as_py() for x in texts)):
                whole = got + end
                for k, cut in enumerate(range(0, len(whole), most)):
                    part = whole[cut : cut + most]
                    rows.append((k, cut // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                    place.append(i)
                size += len(whole) if keep_ids else 0
                if size > (8 << 20) or i + 1 == len(texts):
                    piece, start, length, crc, part = zip(*rows, strict=True)
                    columns = [ids.take(pa.array(place)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                    if keep_ids:
                        columns.append(pa.array(part, pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)
                    rows, place, size = [], [], 0

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, s: PackSettings) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length; lengths come from the longest on.  Of equally good sequences the first opened
    is taken."""
    capacity = np.array([s.tokens, s.documents, s.attention], float)
    wt, wd, wa = s.weights
    needs = np.column_stack([lengths, np.ones_like(lengths), lengths.astype(float) ** 2]) / capacity
    least = needs.min(axis=0) if len(needs) else None
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_number, open_free, opened = np.empty(len(lengths), np.int64), np.empty((len(lengths), 3)), 0
    numbers = 0
    for i, need in enumerate(needs):
        free = open_free[:opened]
        fits = np.flatnonzero((free >= need - 1e-12).all(axis=1)) if opened else ()
        if len(fits):
            rest = free[fits]
            if s.score == "dot":
                a, b, c = (rest * need).T
            else:
                a, b, c = ((rest - need) ** 2).T
            score = wt * a + wd * b + wa * c
            ties = fits[score == score.min()]
            best = ties[0] if len(ties) == 1 else ties[np.argmin(open_number[ties])]
        else:
            best, opened = opened, opened + 1
            open_number[best], open_free[best] = numbers, 1.0
            numbers += 1
        bins[i], offsets[i] = open_number[best], round((1 - open_free[best, 0]) * s.tokens)
        open_free[best] -= need
        if (open_free[best] < least - 1e-12).any():  # nothing fits any more
            opened -= 1
            open_number[best], open_free[best] = open_number[opened], open_free[opened]
    return bins, offsets


def pack(pieces: DataFrame, settings: PackSettings = PackSettings()) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0 in each sequence) to pieces, which have a column length.

    Raises ValueError in the task where a piece is longer than a sequence.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    held = pieces.select(*own)
    n = held.count()
    tasks = max(1, -(-n // settings.pieces_per_task))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema) + ", sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks()
        lengths = whole["length"].to_numpy()
        if lengths.max() > settings.tokens or lengths.max() ** 2 > settings.attention:
            raise ValueError("a piece exceeds what a sequence holds")
        order = np.argsort(-lengths, kind="stable")
        bins, offsets = best_fit(lengths[order], settings)
        whole = whole.take(pa.array(order))
        whole = whole.append_column("sequence_id", pa.array((np.int64(TaskContext.get().partitionId()) << 40) + bins)).append_column("offset", pa.array(offsets))
        yield from whole.to_batches(max_chunksize=10_000)

    # dealt out row by row, not by a key: no document or source gathers in a task
    return held.repartition(tasks).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, settings: PackSettings = PackSettings(), end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    return pack(stored(pieces(docs, path, settings, end_id, keep_ids), "pieces"), settings)

