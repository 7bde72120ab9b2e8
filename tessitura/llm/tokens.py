"""Token ids of whole texts with files of the ``tokenizers`` library.

The library splits a text into pieces and runs byte-pair merges on each piece alone, so the ids of
a text are the joined ids of its pieces, and of its words (runs that no piece reaches over). Prose
repeats its words; :class:`PieceEncoder` therefore numbers the words of a batch with Arrow, looks
up only distinct ones, splits a new word and asks the library's model once, and remembers the answer
(bounded). Texts with characters whose class differs between Unicode versions go to the library whole.
"""

from __future__ import annotations

import codecs
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The split patterns of the two public vocabularies, with the commonest alternative first
#: (no two of the alternatives that changed places can match at one character).
PATTERNS = {
    "byte_bpe": r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word_bpe": r"\p{L}+|'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\p{L}\p{N}]+",
}
#: Words of the byte vocabulary keep a space before them; the white space left over is cut as its pattern cuts it.
SPACED_WORDS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Outside of these blocks (and for capital sigma, whose lower case depends on its place) the library gets the text whole.
# So it does with the four separators that only Python takes for white space.
UNUSUAL = regex.compile("[^\x00-\x1b\x20-ʯͰ-΢Τ-՗‐-⁮₠-₿　-ゖァ-ヿ一-龥가-힣\U0001f300-\U0001f64f]")
#: Of the usual characters, those that may stand in a text whose words are parted by plain replacement: no control
#: characters, and of white space only the space and the line feed.
UNPARTED = regex.compile("[^\n\x20-\x7e\xa1-ʯͰ-΢Τ-՗\u2010-\u2027\u202a-\u202e\u2030-\u205e\u2060-⁮₠-₿、-ゖァ-ヿ一-龥가-힣\U0001f300-\U0001f64f]")
MARK = "\0"


def vocabulary_path(name: str) -> str:
    """Where the named file of the public tokenizers lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> str:
    """The characters by which byte-level vocabularies name the 256 bytes: printable Latin-1 stands for itself, the others for 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


class Memory(dict):
    """Answers of ``ask`` for the last used ``kept`` to 2 x ``kept`` keys: when it is full, it becomes the old one."""

    def __init__(self, ask: Callable[[str], bytes], kept: int) -> None:
        super().__init__()
        self.ask, self.kept, self.old = ask, kept, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.ask(key)
        self[key] = found
        return found

    def turn(self) -> None:
        if len(self) > self.kept:
            self.old = dict(self)
            self.clear()


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, the same as ``encode(text, add_special_tokens=False)``.

    The strings of special tokens in a text are ordinary text (``encode_special_tokens``), as the
    public vocabularies' description has it; with ``specials`` they are their own ids, as by the
    library's default.
    """

    def __init__(self, path: str, kept: int = 400_000, specials: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()] if specials else []
        self.special = re.compile("|".join(added), re.IGNORECASE) if added else None
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        self.find = regex.compile(PATTERNS["word_bpe" if self.lower else "byte_bpe"]).findall
        self.names = byte_characters()
        self.memory = Memory(self._word, kept)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if self.lower:
            word = word.lower()
        letters = word if self.lower or word[0] != " " else word[1:]
        if not letters.isalpha():
            core = letters.rstrip(",.;:!?")
            pieces = [word[: len(core) - len(letters)], letters[len(core) :]] if core != letters and core.isalpha() else self.find(word)
            if len(pieces) > 1:
                return b"".join(map(self.memory.__getitem__, pieces))
            if not pieces:  # white space that the vocabulary drops
                return b""
            word = pieces[0]
        named = codecs.charmap_decode(word.encode(), "strict", self.names)[0]
        return array("I", [t.id for t in self.model.tokenize(named)]).tobytes()

    def _parted(self, text: str) -> str | None:
        """``text`` with a mark between its words; None where that takes the library or the pattern."""
        if UNPARTED.search(text) or self.lower and not unicodedata.is_normalized("NFC", text) or self.special and self.special.search(text):
            return None
        if self.lower:
            return text.replace("\n", MARK).replace(" ", MARK)
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return None
        return text.replace("\n", f"{MARK}\n{MARK}").replace(" ", f"{MARK} ")

    def _other(self, text: str) -> bytes:
        if UNUSUAL.search(text) or self.lower and not unicodedata.is_normalized("NFC", text) or self.special and self.special.search(text):
            return self._library([text])[0]
        return b"".join(map(self.memory.__getitem__, text.split() if self.lower else SPACED_WORDS.findall(text)))

    def _batch(self, parted: list[str]) -> list[bytes]:
        """Ids of texts of marked words: each distinct word of the batch is looked up once."""
        words = pc.split_pattern(pa.array(parted, pa.string()), MARK)
        coded = words.flatten().dictionary_encode()
        ids = pa.array(list(map(self.memory.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist())), pa.binary()).take(coded.indices)
        stops = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)[words.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2]) if stops[-1] else memoryview(b"")
        return [bytes(data[i:j]) for i, j in zip(stops, stops[1:], strict=False)]

    def encode(self, texts: Iterable[str], at_once: int = 1 << 23) -> list[bytes]:
        """Ids of each text; batches of about ``at_once`` characters bound the memory."""
        out: list[bytes | None] = []
        parted: list[str] = []
        places: list[int] = []
        held = 0

        def place() -> None:
            nonlocal held
            self.memory.turn()
            for i, ids in zip(places, self._batch(parted), strict=True):
                out[i] = ids
            parted.clear(), places.clear()
            held = 0

        for text in texts:
            marked = self._parted(text)
            out.append(self._other(text) if marked is None else None)
            if marked is not None:
                places.append(len(out) - 1), parted.append(marked)
                held += len(text)
                if held >= at_once:
                    place()
        if parted:
            place()
        return out


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(name: str, kept: int = 400_000, specials: bool = False) -> PieceEncoder:
    """One encoder per Python worker, vocabulary file and size of its memory; it stays for the worker's next task."""
    if (name, kept, specials) not in _encoders:
        _encoders[name, kept, specials] = PieceEncoder(name if os.path.isabs(name) else vocabulary_path(name), kept, specials)
    return _encoders[name, kept, specials]
