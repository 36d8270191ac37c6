"""Exact encoding and decoding with a merge-type (BPE) SentencePiece model.

Encoding looks for the one token sequence in which every two neighbours are compatible: re-merging
their joined text gives the two tokens back. It takes the longest vocabulary match at each position
(Aho-Corasick), steps back to shorter matches when the pair is not compatible, and marks positions
that cannot be finished in a bitfield, so no position is tried twice. Text is first parted where no
vocabulary piece can reach across; parts that recur keep their encoding in a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class PieceCodec:
    """encode(text) and decode(ids) as the sentencepiece library does them, without sampling."""

    def __init__(self, model_path: str, cache_size: int = 80_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE:
            raise ValueError("a merge-type model is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation with kept, prefixed white space is supported")
        if any(p.type in (_USER, _UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.unknown = self.kinds.index(_UNKNOWN)
        self.unknown_surface = model.trainer_spec.unk_surface
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == _BYTE}
        self.fallback = bool(model.trainer_spec.byte_fallback)
        self.scores = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == _NORMAL}
        # a piece that its own text does not merge into can never be a token
        self.reachable = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        self.matches = ahocorasick.Automaton()
        for p in self.reachable:
            self.matches.add_word(p, p)
        self.matches.make_automaton()
        self.parts = self._parts({a + b for p in self.ids for a, b in zip(p, p[1:])})
        self.fits: dict[tuple[str, str], bool] = {}
        self.digits = {p: str(i) for p, i in self.ids.items()}
        self.shown = {p: self.pieces[i].replace(_SPACE, " ") for p, i in self.ids.items()}
        # two generations: parts in use move to the newer one, the older one goes when that is full
        self.cache: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.cache_size = cache_size

    @staticmethod
    def _parts(inner: set[str]) -> re.Pattern:
        """Parts of an escaped text that no piece reaches across; ``inner`` has all neighbours within pieces."""
        if any(x[0] != _SPACE and x[1] == _SPACE for x in inner):
            return re.compile("(?s:.+)")
        alone = "" if any("\n" in x for x in inner) else "\n"
        # marks that never follow one of these letters within a piece
        letter = "[A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿ]"
        follow = {x[1] for x in inner if re.match(letter, x[0])}
        marks = "".join(m for m in "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~" if m not in follow)
        word = [f"{_SPACE}*{letter}++(?=[{re.escape(marks)}])"] if marks else []
        return re.compile("|".join([f"[{alone}]"] * bool(alone) + word + [f"{_SPACE}+[^{_SPACE}{alone}]*", f"[^{_SPACE}{alone}]+"]))

    def merge(self, text: str) -> list[str]:
        """The pieces of ``text`` by repeated merging: always the best-scored pair, the leftmost of equals."""
        now, scores = list(text), self.scores
        while len(now) > 1:
            best, at = None, -1
            for i in range(len(now) - 1):
                s = scores.get(now[i] + now[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            now[at : at + 2] = [now[at] + now[at + 1]]
        return now

    def compatible(self, a: str, b: str) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 250_000:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(a + b) == [a, b]
        return known

    def part(self, text: str) -> list[str]:
        """The pieces of a part by backtracking; characters outside the vocabulary stand for themselves."""
        n, at, before = len(text), 0, None
        fits, compatible = self.fits, self.compatible
        out: list[str] = []
        for last, p in self.matches.iter_long(text):  # the longest matches one after another are right for most parts
            if last + 1 - len(p) != at:
                break
            if before is not None:
                fit = fits.get((before, p))
                if not (compatible(before, p) if fit is None else fit):
                    break
            out.append(p)
            before = p
            at = last + 1
        if at == n:
            return out
        ends: dict[int, list[str]] = {}
        for last, p in self.matches.iter(text):  # every match, by where it starts; longest last
            start = last + 1 - len(p)
            if start in ends:
                ends[start].append(p)
            else:
                ends[start] = [p]
        choice, place = [], 0  # which of the options was taken; so far always the longest
        for p in out:
            options = ends[place]
            if len(options[0]) > 1:  # a character that is no piece stands for itself
                options.insert(0, text[place])
            choice.append(len(options) - 1)
            place += len(p)
        failed = bytearray(n // 8 + 1)  # a bit for each position from which no compatible rest was found
        any_failed = False
        pick = None
        while at < n:
            options = ends.get(at)
            if options is None or len(options[0]) > 1:
                options = ends[at] = [text[at], *(options or ())]
            i = len(options) - 1 if pick is None else pick
            pick = None
            before = out[-1] if out else None
            while i >= 0:
                p = options[i]
                end = at + len(p)
                if not any_failed or not failed[end >> 3] >> (end & 7) & 1:
                    if before is None:
                        break
                    fit = fits.get((before, p))
                    if compatible(before, p) if fit is None else fit:
                        break
                i -= 1
            if i >= 0:
                out.append(p)
                choice.append(i)
                at += len(p)
                continue
            if not out:
                raise RuntimeError("no compatible pieces: the vocabulary is not of the merge type")
            failed[at >> 3] |= 1 << (at & 7)
            any_failed = True
            at -= len(out.pop())
            pick = choice.pop() - 1
        return out

    def _numbers(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.fallback:
                out += [self.bytes[x] for x in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def _known(self, text: str) -> tuple[str, int, str]:
        """(ids joined by commas, their number, their text) of a part that the newer cache lacks."""
        found = self.older.get(text)
        if found is None:
            pieces = self.part(text)
            try:
                found = (",".join([self.digits[p] for p in pieces]), len(pieces), "".join([self.shown[p] for p in pieces]))
            except KeyError:
                ids = self._numbers(pieces)
                found = (",".join(map(str, ids)), len(ids), self._surface(ids))
        if len(text) <= 64:
            if len(self.cache) >= self.cache_size:
                self.older, self.cache = self.cache, {}
            self.cache[text] = found
        return found

    def _escaped(self, text: str) -> str:
        text = text.replace(" ", _SPACE)
        return _SPACE + text if self.prefix and text else text

    def encode(self, text: str) -> list[int]:
        return [i for p in self.parts.findall(self._escaped(text)) for i in self._numbers(self.part(p))]

    def _surface(self, ids: list[int]) -> str:
        """The text of ids, its first blank kept. Runs of byte pieces are UTF-8; bytes that are not become U+FFFD."""
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.kinds[i] == _BYTE:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i >= 0 and self.kinds[i] == _UNKNOWN:
                out.append(self.unknown_surface)
            elif i >= 0 and self.kinds[i] != _CONTROL:
                out.append(self.pieces[i].replace(_SPACE, " "))
        return "".join(out)

    def _trimmed(self, surface: str) -> str:
        return surface[1:] if self.prefix and surface[:1] == " " else surface

    def decode(self, ids: list[int]) -> str:
        """The blank that encoding put before a text goes, if the first piece has one."""
        first = next((i for i in ids if self.kinds[i] != _CONTROL), None)
        surface = self._surface(ids)
        return self._trimmed(surface) if first is not None and self.pieces[first][:1] == _SPACE else surface

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, sha256 of the ids, sha256 of the decoded text): by parts, as a byte run never crosses one."""
        get, known = self.cache.get, self._known
        rows = []
        for p in self.parts.findall(self._escaped(text)):
            row = get(p)
            if row is None:
                row = known(p)
                get = self.cache.get
            rows.append(row)
        ids = ",".join([r[0] for r in rows])
        back = self._trimmed("".join([r[2] for r in rows]))
        return sum([r[1] for r in rows]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def _utf8(raw: bytes) -> str:
    """Each byte that starts no whole character becomes one U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """One codec for each model in a process: its cache serves all tasks of a worker."""
    if model_path not in _CODECS:
        _CODECS[model_path] = PieceCodec(model_path)
    return _CODECS[model_path]


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string), a row for each input row.

    A null or empty text has no ids and decodes to an empty text. Repeated rows are encoded each;
    null ids and extra columns do not matter; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = [c.encode(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what ``encode`` gives, as counts and digests.

    Edge cases as in ``encode``; an empty text has the digests of nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            rows = [c.digest(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
