"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text over ``chunk`` characters is encoded in chunks that overlap. Two neighbours are spliced at a common
boundary: a place in their overlap after ASCII white space where both have a token begin. The vocabulary's
pre-tokenizer drops white space and no merge, normalisation or special token reaches across it, so such a
boundary is one of the whole text's too. Where the overlap has none, the left chunk grows to the right,
by twice as much each time, until there is one or the text ends.

Shorter texts are split at the same kind of boundary, and the counts of words are kept by each worker.

Null texts count as empty: no bytes, no tokens. Rows are counted one by one; repeated rows give equal
results, and columns other than the text pass through unread.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkfold.llm.common import extended

CHUNK = 50_000
OVERLAP = 400
#: Words whose counts each worker keeps.
KEPT = 500_000

_GAP = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: White space to str.split, but not to the vocabulary.
_ODD = re.compile(r"[\x1c-\x1f]")


class Counter(dict):
    """Token counts of words by one tokenizer; starts anew when full, so its size is bounded."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __missing__(self, word: str) -> int:
        if word.isascii() and len(word) > 1:
            if word.isalpha():
                if not word.islower():
                    # The vocabulary folds case itself; letters alone make no special token.
                    return self[word.lower()]
                # Nothing to normalise or split: the model alone gives the tokens.
                return self._keep(word, len(self.tokenizer.model.tokenize(word)))
            elif word[-1] in ".,;:!?" and word[-2].isalnum():
                # Letters and digits never share a pre-token with such a mark, nor does a special token hold one.
                return self[word[:-1]] + self[word[-1]]
        return self._keep(word, len(self.tokenizer.encode(word, add_special_tokens=False)))

    def _keep(self, word: str, n: int) -> int:
        if len(word) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if len(text) > chunk:
            return self.spliced(text, chunk, overlap)
        words = _GAP.split(text) if _ODD.search(text) else text.split()
        return sum(map(self.__getitem__, words))

    def _starts(self, text: str, begin: int, end: int) -> list[int]:
        """Places in the text where tokens of this chunk begin."""
        return [begin + a for a, _ in self.tokenizer.encode(text[begin:end], add_special_tokens=False).offsets]

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of the whole text from overlapping chunks."""
        total, begin, splice = 0, 0, 0
        end = min(chunk, len(text))
        starts = self._starts(text, begin, end)
        while end < len(text):
            follow = max(begin + 1, end - overlap)
            follow_end = min(follow + chunk, len(text))
            following = self._starts(text, follow, follow_end)
            common = set(starts).intersection(following)
            stable = [p for p in common if p > max(follow, splice) and p < end and text[p - 1] in " \t\n\r\x0b\x0c" and not text[p].isspace()]
            if not stable:
                # No boundary that both share: the left chunk takes in more of the text.
                overlap *= 2
                end = min(end + overlap, len(text))
                starts = self._starts(text, begin, end)
                continue
            cut = max(stable)
            total += sum(splice <= p < cut for p in starts)
            begin, end, starts, splice = follow, follow_end, following, cut
        return total + sum(p >= splice for p in starts)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(
    docs: DataFrame, path: str, limit: int = 2048, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, keep: list[str] | None = None
) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` of every text; ``path`` is the tokenizer's file on every machine."""
    added = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]

    def run(batches):
        own = counter(path)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([own.count(t, chunk, overlap) for t in texts], pa.int64())],
                names=[*keep, "n_bytes", "n_tokens"],
            )

    read = docs.select(*dict.fromkeys([*keep, text]))
    out = read.mapInArrow(run, extended(read.select(*keep).schema, n_bytes="long", n_tokens="long"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
