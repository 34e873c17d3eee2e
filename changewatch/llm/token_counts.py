"""Token counts: batch encoding inside Arrow functions that return lengths only.

Batches are filled up to a number of bytes rather than rows. A long text is
cut at *safe* boundaries, where a byte-level pre-tokenizer starts a new token
whatever stands around: before a space or a line end that follows another
character than white space, and after the punctuation of scripts that are
written without spaces. So the tokens of a text are the tokens of its
sections, one after the other. A run without any such boundary is one word to
the vocabulary and is encoded whole.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from changewatch.llm.common import beside, by_bytes

_SAFE = re.compile(r"(?<=\S)(?=[ \n])|(?<=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])(?=[^\W_])")
_WORD_GAP = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: how the byte-level vocabularies cut a text before merging, and what that comes to where no two characters of white space meet.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SINGLE_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: White space below U+0250 besides the space and the line feed.
_RARE_SPACES = "\t\r\x0b\x0c\x85\xa0"
#: Bytes of text in one batch, and characters of a section of a long text.
BATCH_BYTES = 2_000_000
SECTION_CHARS = 50_000


def sections(text: str, size: int = SECTION_CHARS) -> list[str]:
    """The text cut at safe boundaries, each section but the last at least ``size`` long."""
    out, start = [], 0
    while len(text) - start > size and (found := _SAFE.search(text, start + size)):
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out


class Encoder:
    """Encodes batches of texts with one vocabulary file.

    Special strings within a text are treated as the library does by default.
    Vocabularies without safe boundaries (those with a normaliser, and
    sentencepiece models) get whole texts.

    ``ranks``: a file that holds the same byte-level vocabulary as ranks. If it
    is given, text in Latin letters (code points below U+0250, whose classes no
    version of Unicode has changed) is encoded with it, in batches too, which
    gives the same ids about six times faster; words with other characters or a special string
    go to the library of ``path``.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.ranked = self.chunked = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.batch = {"library": lambda texts: model.encode(texts, num_threads=1)}
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.batch = {"library": lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]}
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.chunked = type(tokenizer.pre_tokenizer).__name__ == "ByteLevel" and tokenizer.normalizer is None and not tokenizer.pre_tokenizer.add_prefix_space
        if ranks and self.chunked:
            import tiktoken

            self.ranked = True
            with open(ranks, "rb") as f:
                own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            for name, pattern in (("spaced", _PATTERN), ("single", _SINGLE_SPACES)):
                self.batch[name] = functools.partial(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own, special_tokens={}).encode_ordinary_batch, num_threads=1)

    def _latin(self, text: str) -> bool:
        return (text.isascii() or max(text) < "\u0250") and not any(s in text for s in self.special)

    def _way(self, text: str) -> str:
        met = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in _RARE_SPACES)
        return "spaced" if met else "single"

    def _parts(self, text: str) -> Iterator[tuple[str, str]]:
        """(how to encode it, section)."""
        if not self.chunked:
            yield "library", text
            return
        for section in sections(text):
            if not self.ranked:
                yield "library", section
            elif self._latin(section):
                yield self._way(section), section
            else:
                words = _WORD_GAP.split(section)
                words[1:] = [" " + w for w in words[1:]]
                for latin, run in itertools.groupby(words, self._latin):
                    part = "".join(run)
                    yield self._way(part) if latin else "library", part

    def __call__(self, texts: list[str]) -> Iterator[list[list[int]]]:
        """For each text the ids of its sections; one call of each way for all of ``texts``."""
        parts = [list(self._parts(t)) for t in texts]
        by_way: dict[str, list[str]] = {}
        for way, part in itertools.chain.from_iterable(parts):
            by_way.setdefault(way, []).append(part)
        ids = {way: iter(self.batch[way](them)) for way, them in by_way.items()}
        for ps in parts:
            yield [next(ids[way]) for way, _ in ps]

    def lengths(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        return [sum(map(len, ids)) for ids in self(texts)]


@functools.cache
def encoder(path: str, ranks: str | None = None) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    return Encoder(path, ranks)


def token_counts(docs: DataFrame, path: str, ranks: str | None = None, *, text: str = "text", limit: int = 512, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens), a row for each input row.

    A null text counts as empty: 0 bytes, 0 tokens. Texts of any length are
    counted whole. Repeated rows are each counted; an empty table gives an
    empty result; other columns are not read, whatever their names.
    """
    rows = beside(docs, keep, text)
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks)
        for batch, texts in by_bytes(batches, len(keep), BATCH_BYTES):
            tokens = encode.lengths(texts)
            *kept, text_column = batch.columns
            n_bytes = pc.fill_null(pc.binary_length(text_column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*kept, n_bytes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=schema.names)

    return rows.mapInArrow(count, schema)
