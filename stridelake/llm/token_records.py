"""Token ids in length-delimited binary records, with a separate offset index.

A shard file is a run of frames, one for each document in ascending order of its id:

    uint64 LE  length of the payload
    uint32 LE  masked crc32 of those eight bytes
    payload    a byte with the width of an id (2 where all ids of the tokenizer fit, else 4), then
               the ids, little-endian unsigned
    uint32 LE  masked crc32 of the payload

A masked crc is the crc rotated right by 15 bits plus 0xA282EAD8, modulo 2**32, so that a checksum
over stored checksums stays meaningful. Beside ``part-00000.tokens`` lies ``part-00000.index``:
for each frame three little-endian int64, the document's id (the least int64 where it is null), the
frame's byte offset and its number of ids. Readers that shuffle fetch frames by offset.

Tasks write to a name of their own and rename when done, so a repeated task replaces equal bytes.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm.common import as_bytes, work_dir

_NULL = -(1 << 63)
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + _TAIL.pack(masked_crc(size)) + payload + _TAIL.pack(masked_crc(payload))


def read_frame(f) -> bytes | None:
    """The next payload of an open shard, None at its end; ValueError where bytes are damaged or missing."""
    head = f.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size or masked_crc(head[:8]) != _HEAD.unpack(head)[1]:
        raise ValueError("damaged frame length")
    size = _HEAD.unpack(head)[0]
    body = f.read(size + _TAIL.size)
    if len(body) < size + _TAIL.size or masked_crc(body[:size]) != _TAIL.unpack(body[size:])[0]:
        raise ValueError("damaged frame")
    return body[:size]


def _open(uri: str):
    """(file system, path) of a shared folder: local, hdfs, s3 or gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


#: Letters of Latin-1, as text.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Byte-level vocabularies write bytes that are not printable as the characters from U+0100 on; the space stays here.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = np.arange(256, dtype="<u2")
_BYTE_LEVEL[[b for b in range(256) if b not in _SHOWN]] = range(256, 512 - len(_SHOWN))
_BYTE_LEVEL[32] = 32
assert sys.byteorder == "little" and array("I").itemsize == 4

_SPACE, _LETTER, _DIGIT, _APOSTROPHE, _SIGN, _OTHER = range(6)
#: The kind of each byte; bytes of Latin-1 letters beyond ASCII are found by their lead byte.
_KIND = np.full(256, _OTHER, "u1")
_KIND[33:127] = _SIGN
_KIND[list(b"\t\n\v\f\r ")] = _SPACE
_KIND[list(b"0123456789")] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[39] = _APOSTROPHE
#: Bytes that make a letter after 0xC3: all that can follow but those of the signs U+00D7 and U+00F7.
_AFTER_C3 = np.zeros(256, bool)
_AFTER_C3[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
#: [8 * kind before + kind]: whether a part starts there, that is, after white space, or where a pretoken surely ends:
#: signs follow letters, digits stand alone, and letters follow signs (but an apostrophe takes some with it). No cut
#: touches any other byte, and a character of these kinds does not combine with what stands before it.
_STARTS = np.zeros(64, bool)
_STARTS[8 * _SPACE + 1 : 8 * _SPACE + 6] = True
for _a, _b in ((_LETTER, _SIGN), (_LETTER, _APOSTROPHE), (_SIGN, _LETTER), (_DIGIT, _DIGIT), *((_DIGIT, k) for k in (_LETTER, _APOSTROPHE, _SIGN)), *((k, _DIGIT) for k in (_LETTER, _APOSTROPHE, _SIGN))):
    _STARTS[8 * _a + _b] = True


def pack(ids: bytes, narrow: bool) -> bytes:
    """A payload of ids given as little-endian uint32."""
    return b"\x02" + np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else b"\x04" + ids


def unpack(payload: bytes) -> np.ndarray:
    if payload[:1] not in (b"\x02", b"\x04"):
        raise ValueError("unknown width of ids")
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1)


#: What a tokenizer's file must say for its texts to be parted: white space is dropped, letters are put in lower case and
#: parted from marks, digits stand alone, and merges see bytes of one pretoken.
_PARTED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _is_parted(tokenizer) -> bool:
    known = json.loads(tokenizer.to_str())
    model = known["model"]
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
    # special tokens hold no white space and start with <|, which parts keep
    tokens = all(t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in known["added_tokens"])
    return plain and tokens and all(known[k] == v for k, v in _PARTED.items())


def part(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct parts of UTF-8 texts, for each part of the texts in order its place among them, and where each text's parts begin and end."""
    data = np.frombuffer(b"".join(texts), "u1")
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), "i8", len(texts)))))
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_AFTER_C3[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    pair = kind.copy()
    pair[1:] += kind[:-1] << 3
    first = at[at < len(data)]
    pair[first] = kind[first]  # a text starts as after white space
    starts, kept = _STARTS[pair], kind != _SPACE
    offsets = np.append(np.flatnonzero(starts[kept]), np.count_nonzero(kept)).astype("i4")
    found = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])]).dictionary_encode()
    _, ends, raw = found.dictionary.buffers()
    ends, raw = np.frombuffer(ends, "i4", len(found.dictionary) + 1).tolist() if len(found) else [0], raw.to_pybytes() if raw else b""
    return [raw[a:b] for a, b in zip(ends, ends[1:])], found.indices.to_numpy(), np.searchsorted(np.flatnonzero(starts), at)


class WordIds:
    """The ids of texts by a tokenizer of the tokenizers library, kept for parts that recur.

    The text is parted at ASCII white space, which the tokenizer drops, and where its pattern surely
    ends a pretoken; neither its normaliser nor its patterns look across. Each part goes through the
    library once. Texts that hold a special token go through it whole, and so do all texts of a
    tokenizer whose file says otherwise.
    """

    def __init__(self, path: str, cache_size: int = 500_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self.parted = _is_parted(self.tokenizer)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.parted:
            # the same model for words that normalising leaves alone; tokens at a word's end have its suffix
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = CharDelimiterSplit(" ")
            vocab = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # two generations: parts in use move to the newer one, the older one goes when that is full
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.cache_size = cache_size

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        found = []
        for i in range(0, len(texts), 500):
            found += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts[i : i + 500]], add_special_tokens=False)]
        return found

    def _stems(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of lower-case Latin letters, in UTF-8: each is one pretoken. They hold no ``<``, so a token
        that ends in ``</w>`` ends its word; where not all words end so, they go one by one."""
        text = _BYTE_LEVEL[np.frombuffer(b" ".join(words), "u1")].tobytes().decode("utf-16-le")
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
        if len(ends) != len(words):
            return [array("I", [t.id for t in self.words.model.tokenize(w)]).tobytes() for w in text.split(" ")]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """The ids of parts that are not known. Words of Latin letters have those of their lower case."""
        stems, other = {}, []
        for p in parts:
            if p.isalpha():
                stems[p] = p.lower()
            elif not p.isascii() and _LETTERS(text := p.decode()):
                stems[p] = text.lower().encode()
            else:
                other.append(p)
        words = set(stems.values())
        known = {w: ids for w in words if (ids := self.cache.get(w) or self.older.get(w)) is not None}
        new = list(words.difference(known))
        for i in range(0, len(new), 5000):
            known.update(zip(new[i : i + 5000], self._stems(new[i : i + 5000])))
        found = {p: known[w] for p, w in stems.items()}
        found.update(zip(other, self._whole(other)))
        return found

    def _known(self, parts: list[bytes]) -> list[bytes]:
        """The ids of distinct parts."""
        found = list(map(self.cache.get, parts))
        new = [p for p, ids in zip(parts, found) if ids is None]
        if not new:
            return found
        learned = {p: ids for p in new if (ids := self.older.get(p)) is not None}
        if len(self.cache) + len(new) > self.cache_size:
            self.older, self.cache = self.cache, {}
        learned |= self._learn([p for p in new if p not in learned])
        self.cache |= learned
        return [learned[p] if ids is None else ids for p, ids in zip(parts, found)]

    def many(self, texts: list[bytes]) -> list[bytes]:
        """For each UTF-8 text its ids as little-endian uint32."""
        if not self.parted:
            return self._whole(texts)
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        rest = list(texts)
        for i in whole:
            rest[i] = b""
        parts, which, bounds = part(rest)
        ids = self._known(parts)
        size = np.fromiter(map(len, ids), "i8", len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        n = size[which]
        ends = np.concatenate(([0], np.cumsum(n)))
        out = flat[np.repeat(first[which] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        at = (ends[bounds] * 4).tolist()
        found = [out[a:b] for a, b in zip(at, at[1:])]
        for i, t in zip(whole, self._whole([texts[i] for i in whole])):
            found[i] = t
        return found


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def _groups(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """All rows of batches (id, text) in order, as lists of ids and texts; a list ends where its texts reach ``size`` bytes."""
    ids, texts, held = [], [], 0
    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(d)
            texts.append(t)
            held += len(t)
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Writes all documents under ``folder`` and returns (shard int, name string, docs long, tokens long).

    Shards hold ranges of ids, in ascending order (nulls first); within one, rows are sorted by id,
    then by text. A null text is empty: its record holds ``end_id`` alone. Repeated rows are written
    as often as they come. An empty table writes no shard. Extra columns are ignored.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = as_bytes(rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType
        from pyspark import TaskContext

        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        encoder, end = word_ids(tokenizer_path), np.array([end_id], "<u4").tobytes()
        narrow = max(end_id, *encoder.tokenizer.get_vocab().values()) < 1 << 16
        temp, name = f"{root}/.{uuid.uuid4().hex}", f"part-{shard:05d}"
        out, index = None, []
        at = docs_n = tokens = 0
        try:
            for ids, texts in _groups(batches):
                payloads = encoder.many(texts)
                if out is None:
                    out = files.open_output_stream(f"{temp}.tokens", buffer_size=1 << 20)
                for d, p in zip(ids, payloads):
                    p += end
                    f = frame(pack(p, narrow))
                    out.write(f)
                    index.append((_NULL if d is None else d, at, len(p) // 4))
                    at += len(f)
                    docs_n += 1
                    tokens += len(p) // 4
            if out is None:
                return
            out.close()
            with files.open_output_stream(f"{temp}.index") as f:
                f.write(np.array(index, "<i8").tobytes())
            for kind in ("tokens", "index"):
                files.move(f"{temp}.{kind}", f"{root}/{name}.{kind}")
        except BaseException:
            # a task that fails leaves nothing behind
            for kind in ("tokens", "index"):
                if files.get_file_info(f"{temp}.{kind}").type != FileType.NotFound:
                    files.delete_file(f"{temp}.{kind}")
            raise
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([docs_n], pa.int64()), pa.array([tokens], pa.int64())], ["shard", "name", "docs", "tokens"])

    return dealt.mapInArrow(run, "shard int, name string, docs long, tokens long")


def read_records(spark: SparkSession, folder: str, shards: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each record of shards [(name, tokens before it)], checksums verified."""
    files = [(name, int(start)) for name, start in shards]
    table = spark.createDataFrame(files, "name string, start long")
    if len(files) > 1:
        table = table.repartitionByRange(len(files), "name")  # names are few and unlike: a shard or two in each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, root = _open(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with source.open_input_stream(f"{root}/{name}.index") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                rows = []
                with source.open_input_stream(f"{root}/{name}.tokens", buffer_size=1 << 20) as f:
                    for d, _, n in index.tolist():
                        payload = read_frame(f)
                        ids = unpack(payload) if payload else ()
                        if len(ids) != n:
                            raise ValueError(f"{name}: the index does not fit the records")
                        rows.append((None if d == _NULL else d, start, n, zlib.crc32(ids.astype("<u4").tobytes())))
                        start += n
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 10_000])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None, **options) -> DataFrame:
    """Writes ``docs`` and reads the files back: (doc_id, start, n_tokens, ids_crc32). Without a ``folder`` the files
    go when the application ends.

    The driver gets one row for each shard file, whatever the number of documents.
    """
    spark = docs.sparkSession
    folder = folder or f"{work_dir(spark)}/records-{uuid.uuid4().hex}"
    done = sorted({(r.shard, r.name, r.tokens) for r in write_records(docs, folder, tokenizer_path, end_id, **options).collect()})
    shards, start = [], 0
    for _, name, tokens in done:
        shards.append((name, start))
        start += tokens
    return read_records(spark, folder, shards)


def read_shuffled(folder: str, name: str, seed: int) -> Iterator[np.ndarray]:
    """The records of one shard in a shuffled order, fetched through the offset index."""
    source, root = _open(folder)
    with source.open_input_stream(f"{root}/{name}.index") as f:
        index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
    with source.open_input_file(f"{root}/{name}.tokens") as f:
        for i in np.random.default_rng(seed).permutation(len(index)).tolist():
            f.seek(int(index[i, 1]))
            yield unpack(read_frame(f))
