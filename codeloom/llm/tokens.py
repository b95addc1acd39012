"""Token ids of whole columns of texts by a public tokenizer.

Word by word where that is provably the same: a byte-level tokenizer without normalizer cuts text before each single space between other
characters, so the words of many texts are encoded once per batch and their ids put together. Texts in which a space meets other white
space or an end of the text, or which hold an added token, are encoded as they are.
"""

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from codeloom.llm.storage import give_back
from codeloom.llm.words import slices, texts_of

BATCH_BYTES = 12 << 20   # texts of which the distinct words are taken together
RANGE_BYTES = 4 << 20    # texts whose ids are put together at once
JOINED = 200             # words of one string
CALL = 64                # strings of one call

SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
# letters that all Unicode versions have, then ASCII punctuation but the apostrophe, which may start a contraction
STEM = r"(?s)\A(?P<stem>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)(?P<tail>[!-&(-/:-@\[-`{-~]+)\z"
ODD = rf"(?s:\A | {SPACES}|{SPACES} |{SPACES}\z)"


def version_of(content: str) -> str:
    """Digest of a tokenizer file: token counts hold for one version."""
    return hashlib.sha256(content.encode()).hexdigest()


def encoder_of(content) -> "Encoder":
    """The tokenizer of a broadcast file content, made once in a worker process and kept with the broadcast: tasks that each make
    their own leave memory behind."""
    if getattr(content, "encoder", None) is None:
        content.encoder = Encoder(content.value)
    return content.encoder


class Encoder:
    """A tokenizer made from the content of its file. ``special`` tells what strings of special tokens in a text are: the library's
    default, or (``False``) ordinary text."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(content)
        settings = json.loads(content)
        cut = settings.get("pre_tokenizer") or {}
        self.by_word = (settings.get("normalizer") is None and settings.get("truncation") is None and settings.get("padding") is None
                        and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True))
        self.added = [token["content"] for token in settings.get("added_tokens", [])]
        spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            spaced[i] = token.startswith("\u0120")   # a leading space in byte-level vocabularies
        self.spaced = spaced

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """A few texts at a time, as the library's results are many times larger than their ids."""
        found = []
        for i in range(0, len(texts), CALL):
            found += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[i: i + CALL], add_special_tokens=False)]
        return found

    def encode(self, column: pa.Array):
        """For ranges of rows: (first row, ids of all, offsets into them), in order."""
        column = column.cast(pa.large_string()).fill_null("")
        _, offsets = texts_of(column)
        for first, last in slices(offsets, BATCH_BYTES):
            part = column.slice(first, last - first)
            odd = self._odd(part)
            flat, size, code, rows = self._by_word(part.filter(pa.array(~odd)))
            good = np.concatenate([[0], np.cumsum(~odd)])
            for a, b in slices(offsets[first: last + 1], RANGE_BYTES):
                bounds = rows[good[a]: good[b] + 1]
                ids, ends = gathered(flat, size, code[bounds[0]: bounds[-1]], bounds - bounds[0])
                if odd[a:b].any():
                    ids, ends = self._merged(part.slice(a, b - a), odd[a:b], ids, ends)
                yield first + a, ids, ends
            give_back()

    def _odd(self, column: pa.Array) -> np.ndarray:
        if not self.by_word:
            return np.ones(len(column), bool)
        test = pc.match_substring_regex(column, ODD)
        for token in self.added:
            test = pc.or_(test, pc.match_substring(column, token))
        return test.to_numpy(zero_copy_only=False)

    def _merged(self, column: pa.Array, odd: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the other rows are given; those of odd rows are made from the whole texts and put between them."""
        lengths, rows = np.zeros(len(odd), np.int64), np.flatnonzero(odd)
        lengths[~odd] = np.diff(offsets)
        found = self.ids(column.take(pa.array(rows)).to_pylist())
        lengths[rows] = [len(x) for x in found]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.empty(ends[-1], np.uint32)
        ids[np.repeat(~odd, lengths)] = flat
        for row, x in zip(rows, found):
            ids[ends[row]: ends[row + 1]] = x
        return ids, ends

    def _by_word(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, their numbers, the words of all rows as places among these, and the first of each row (one more than rows)."""
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64)
        lists = pc.split_pattern(column, " ")
        rows = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy().copy(), coded.dictionary
        rows = rows - rows[0]
        leads = np.zeros(len(code), bool)
        leads[rows[:-1]] = True
        # a first word has no space before it: codes above the others'
        starts, own = np.unique(code[leads], return_inverse=True)
        inner = np.zeros(len(words), bool)
        inner[code[~leads]] = True
        code = (np.cumsum(inner, dtype=np.int32) - 1)[code]
        code[leads] = inner.sum() + own
        flat, size = self._spaced(words.filter(pa.array(inner)))
        lead = self.ids(words.take(pa.array(starts)).to_pylist())
        return np.concatenate([flat, *lead]), np.concatenate([size, [len(x) for x in lead]]).astype(np.int64), code, rows

    def _spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words after a space, and their numbers. Letters and the punctuation after them are cut apart by the tokenizer, so
        words that differ in it share their letters' ids."""
        parts = pc.extract_regex(words, STEM)
        plain = pc.is_null(parts)
        stems = pc.if_else(plain, words, pc.struct_field(parts, "stem")).dictionary_encode()
        tails = pc.if_else(plain, pa.scalar("", words.type), pc.struct_field(parts, "tail")).dictionary_encode()
        flat, size = self._distinct(stems.dictionary)
        ends = self.ids(tails.dictionary.to_pylist())
        flat, size = np.concatenate([flat, *ends]), np.concatenate([size, [len(x) for x in ends]]).astype(np.int64)
        code = np.empty(2 * len(words), np.int64)
        code[::2], code[1::2] = stems.indices.to_numpy(), tails.indices.to_numpy() + len(stems.dictionary)
        ids, bounds = gathered(flat, size, code, np.arange(0, len(code) + 1, 2))
        return ids, np.diff(bounds)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words after a space, by strings of many; a word begins with the token that holds its space."""
        bounds = np.append(np.arange(0, len(words), JOINED), len(words)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), words.cast(pa.string())), " ").to_pylist() if len(words) else []
        flat = np.concatenate([np.zeros(0, np.uint32), *self.ids([" " + text for text in joined])])
        begins = np.flatnonzero(self.spaced[flat])
        if len(begins) != len(words):
            raise ValueError("a word has no token of its own")
        return flat, np.diff(np.append(begins, len(flat)))


def gathered(flat: np.ndarray, size: np.ndarray, code: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` (of ``size``, one after the other) in the order of ``code``, and where ``rows`` of codes begin and end in them."""
    begin, lengths = np.cumsum(size) - size, size[code]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    kind = np.int32 if ends[-1] < 1 << 31 else np.int64
    at = np.repeat((begin[code] - ends[:-1]).astype(kind), lengths) + np.arange(ends[-1], dtype=kind)
    return flat[at], ends[rows]
