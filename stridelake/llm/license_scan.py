"""Licence mentions by ordered signatures.

A text is put in lower case and its words are joined by single blanks. Signatures (regular
expressions over that form) run only where their keyword occurs, all of which one pass finds. Of overlapping detections the one
with the higher priority stands, then the longer, then the earlier rule; what lies within a
detection that stands is suppressed. Three base phrases are counted at all their places.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import as_bytes
from stridelake.llm.license_signatures import Signature, signatures

#: Phrase to label; these are found wherever their words stand consecutively.
BASE = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}
#: Letters, digits and all bytes of characters above U+007F are parts of words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Scanner:
    def __init__(self, rules: list[Signature] | None = None):
        self.by_keyword: dict[bytes, list[Signature]] = defaultdict(list)
        for r in signatures() if rules is None else rules:
            self.by_keyword[r.keyword].append(r)
        self.keywords = ahocorasick.Automaton()
        for k in self.by_keyword:
            self.keywords.add_word(k.decode("latin-1"), k)
        self.keywords.make_automaton()

    def detections(self, line: bytes) -> list[tuple[int, int, Signature]]:
        """(start, end, rule) in bytes of what stands; ``line`` has a blank before and after each word."""
        found = []
        held = {k for _, k in self.keywords.iter(line.decode("latin-1"))} if self.by_keyword else ()
        for keyword in held:
            for r in self.by_keyword[keyword]:
                found += [(m.start(), m.end(), r) for m in r.pattern.finditer(line)]
        found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[2].order, x[0]))
        starts: list[int] = []
        ends: list[int] = []  # of the intervals that stand and lie in no other: both ascend
        out = []
        for a, b, r in found:
            i = bisect_right(starts, a)
            if i and ends[i - 1] >= b:
                continue
            out.append((a, b, r))
            j = i
            while j < len(ends) and ends[j] <= b:
                j += 1
            lo = i - 1 if i and starts[i - 1] == a else i
            starts[lo:j], ends[lo:j] = [a], [b]
        return out

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = text.translate(_WORDS).split()
        if not words:
            return 0, 0, None, None, "", "", 0.0
        line = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in BASE.items():
            if phrase in line:
                asked = b" " + phrase + b" "
                at = line.find(asked)
                while at >= 0:
                    places.append(at)
                    base.add(label)
                    at = line.find(asked, at + 1)
        stands = self.detections(line)
        first = last = None
        if places:
            first = line.count(b" ", 0, min(places) + 1) - 1
            last = line.count(b" ", 0, max(places) + 1) - 1
        labels = base | {r.label for _, _, r in stands}
        score = max([r.priority / 100 for _, _, r in stands], default=0.0)
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score

    def spans(self, text: bytes) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, priority) of what stands, in order of place."""
        words = text.translate(_WORDS).split()
        line = b" " + b" ".join(words) + b" "
        return [(r.label, line.count(b" ", 0, a) - 1, line.count(b" ", 0, b), r.priority / 100) for a, b, r in sorted(self.detections(line), key=lambda x: x[:2])]


_SCANNERS: list[Scanner] = []


def _scanner() -> Scanner:
    if not _SCANNERS:
        _SCANNERS.append(Scanner())
    return _SCANNERS[0]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each input row.

    Null, empty and wordless texts have no places, no labels and score 0. score is the highest
    priority (0 to 1) of what stands. Repeated rows are scanned each; null ids stay null; extra
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _scanner()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            rows = [s.scan(x.as_buffer().to_pybytes()) for x in b.column(1)]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = dict(docs.dtypes)[doc_id]
    source = as_bytes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
