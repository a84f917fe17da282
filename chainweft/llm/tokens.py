"""Token-ID output: Parquet list columns with chosen encodings, row groups and page indexes.

Files hold one row for each document, in ascending order of ``doc_id`` over the whole set:

* ``tokens`` (list of ids) is dictionary encoded, since a vocabulary is small;
* ``doc_id``, ``part``, ``row``, ``at`` and ``n_tokens`` only grow or change little, so they are
  delta encoded (writer version 2);
* row groups and pages have set sizes, and page indexes hold the bounds of ``doc_id``, so a
  reader fetches chosen documents, or only the metadata columns, without the other pages.

``at`` counts the ids before a document within its part; the starts over all parts need only the
parts' totals, so a document's place is found without reading tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweft.llm.text import batches_of
from chainweft.session import shared_dir

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 5_000
#: A special token of the vocabulary.
PARTING = "<|startoftext|>"
#: Pieces that a worker keeps with their ids, the first to come up to a length.
CACHED_PIECES, CACHED_LENGTH = 300_000, 48
#: Text that is encoded at once.
BATCH_BYTES = 4 << 20
#: A Latin or Cyrillic letter and a sign; without U+0130, which is read as a letter and a mark.
LETTER_SIGN = (
    r"([a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{400}-\x{481}\x{48A}-\x{52F}])"
    r"([!-/:-@\[-`{-~])"
)

SCHEMA = "doc_id long, part int, row int, at long, n_tokens int, tokens array<int>"
OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.dictionary.page.size": str(2 << 20),
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "compression": "zstd",
}


class _Pieces:
    """Ids of pieces of text, as long as a worker lives.

    The tokenizer drops white space, reads A-Z as lower case and ends a run of letters where a
    sign follows, so the ids of a text are those of its words and of the runs after them. A worker
    keeps the first ``CACHED_PIECES`` and encodes the new ones of a batch together. Texts with
    the beginning of a special token are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parting = self.tokenizer.token_to_id(PARTING)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        #: whether an id ends a run of letters
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.known = pa.array([], pa.string())
        self.ids, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, encoded as one text, and how many each has."""
        ids = self._whole(" ".join(words))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):  # a word has one run at least, so some word has several
            return self._parted(words)
        return ids, np.diff(ends, prepend=0)

    def _parted(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, encoded as one text with a special token between them, and how many each has."""
        ids = self._whole(f" {PARTING} ".join(pieces))
        marks = ids == self.parting
        return ids[~marks], np.diff(np.flatnonzero(np.append(marks, True)), prepend=-1) - 1

    def _learn(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """New pieces in the order in which they were encoded, their ids and how many each has."""
        letters = pc.utf8_is_alpha(pieces)
        kinds = [(self._letters, pieces.filter(letters)), (self._parted, pieces.filter(pc.invert(letters)))]
        done = [run(found.slice(at, 1000).to_pylist()) for run, found in kinds for at in range(0, len(found), 1000)]
        return pa.concat_arrays([found for _, found in kinds]), *(np.concatenate(x) for x in zip(*done, strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text begins, the end of all included."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        special = pc.match_substring(texts, "<|")
        split = pc.ascii_split_whitespace(pc.if_else(special, "", _spaced(pc.ascii_lower(texts))))
        table = split.flatten().dictionary_encode()
        pieces, ids, sizes = self.known, self.ids, self.sizes
        new = table.dictionary.filter(pc.invert(pc.is_in(table.dictionary, pieces)))
        if len(new):
            found, new_ids, new_sizes = self._learn(new)
            pieces, ids, sizes = pa.concat_arrays([pieces, found]), np.append(ids, new_ids), np.append(sizes, new_sizes)
            if len(self.known) < CACHED_PIECES:
                self._keep(pieces, ids, sizes)
        place = pc.index_in(table.dictionary, pieces).to_numpy()[table.indices.to_numpy()]
        begins, length = np.cumsum(sizes) - sizes, sizes[place]
        ends = np.append(0, np.cumsum(length))
        out = ids[np.repeat(begins[place] - ends[:-1], length) + np.arange(ends[-1])]
        starts = ends[split.offsets.to_numpy()]
        if not pc.any(special).as_py():
            return out, starts
        rows = np.split(out, starts[1:-1])
        for at in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            rows[at] = self._whole(texts[at].as_py())
        return np.concatenate(rows), np.append(0, np.cumsum([len(row) for row in rows]))

    def _keep(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keep the first pieces up to the limit, without very long ones."""
        short = pc.less_equal(pc.binary_length(pieces), CACHED_LENGTH).to_numpy(zero_copy_only=False)
        short &= np.cumsum(short) <= CACHED_PIECES
        self.known, self.ids, self.sizes = pieces.filter(pa.array(short)), ids[np.repeat(short, sizes)], sizes[short]


def _spaced(texts: pa.Array) -> pa.Array:
    """Texts with a space between a letter and an ASCII sign after it."""
    return pc.replace_substring_regex(texts, pattern=LETTER_SIGN, replacement=r"\1 \2")


_LOADED: dict[str, _Pieces] = {}


def encode_all(texts: pa.Array, path: str, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts in a row and where each one begins; a null text is empty."""
    if path not in _LOADED:
        _LOADED[path] = _Pieces(path)
    ids, begins = _LOADED[path].encode(texts)
    if end_id is None:
        return ids, begins
    return np.insert(ids, begins[1:], np.int32(end_id)), begins + np.arange(len(begins))


def encode(texts: list[bytes | None], path: str, end_id: int | None = END_ID) -> list[np.ndarray]:
    """Ids of each whole text; a null text is empty."""
    ids, begins = encode_all(pa.array(texts, pa.binary()), path, end_id)
    return np.split(ids, begins[1:-1]) if texts else []


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with ``BATCH_BYTES`` of text at most, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
        start, held = 0, 0
        for at, size in enumerate(sizes.tolist()):
            if held + size > BATCH_BYTES and at > start:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def _encoded(path: str, end_id: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, at = TaskContext.get().partitionId(), 0, 0
        for piece in _bounded(batches):
            ids, offsets = encode_all(piece.column("text"), path, end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            n, size = np.diff(offsets), piece.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"), pa.array(np.full(size, part, np.int32)), pa.array(np.arange(row, row + size, dtype=np.int32)),
                    pa.array(at + offsets[:-1]), pa.array(n.astype(np.int32)), lists,
                ],
                ["doc_id", "part", "row", "at", "n_tokens", "tokens"],
            )
            row, at = row + size, at + int(offsets[-1])

    return run


def write(documents: DataFrame, to: str, path: str, end_id: int = END_ID) -> None:
    """Write the ids of every whole text to the folder ``to``, rows without an id first.

    Equal ids stand in the order of their texts, so repeated rows give the same files again.
    Other columns are not written. An empty table gives files without rows.
    """
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ordered = narrow.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    writer = ordered.mapInArrow(_encoded(path, end_id), SCHEMA).write
    for key, value in OPTIONS.items():
        writer = writer.option(key, value)
    with batches_of(documents.sparkSession, 2000):
        writer.parquet(to)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The files' rows; columns and ``doc_id`` ranges that are not asked for are not fetched."""
    return spark.read.schema(SCHEMA).parquet(folder)


def starts(files: DataFrame) -> DataFrame:
    """``part`` and ``before``, the ids of all parts before it: one row for each file."""
    totals = files.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n")).orderBy("part").collect()  # a row for each part
    rows, before = [], 0
    for part, n in totals:
        rows.append((part, before))
        before += n
    return files.sparkSession.createDataFrame(rows, "part int, before long")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = [zlib.crc32(ids.values.to_numpy().astype("<u4").tobytes()) for ids in batch.column("tokens")]
        keep = [batch.column(k) for k in ("doc_id", "part", "at", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(crc, pa.int64())], ["doc_id", "part", "at", "n_tokens", "crc"])


def digests(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of each document, from the files."""
    found = files.select("doc_id", "part", "at", "n_tokens", "tokens").mapInArrow(_summed, "doc_id long, part int, at long, n_tokens int, crc long")
    return found.join(F.broadcast(starts(files)), "part").select(  # a row for each file
        "doc_id", (F.col("before") + F.col("at")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


def written(documents: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Files of ids in a new folder of the shared one, read back; the vocabulary's place is ``path``."""
    import uuid

    spark = documents.sparkSession
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path(VOCABULARY))
    to = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(documents, to, path, end_id)
    return read(spark, to)
