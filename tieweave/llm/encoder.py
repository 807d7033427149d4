"""Token ids of whole texts by a public byte-level BPE vocabulary.

The pre-tokenizer of such a vocabulary never joins a sign with white space that follows it, so a text
may be cut in front of each run of white space and the parts be encoded one by one: the ids are those
of the whole text.  Words repeat, so each task encodes a part once and keeps its ids.
"""

from __future__ import annotations

import os
import re
from itertools import chain
from weakref import WeakKeyDictionary

import numpy as np
from pyspark import Broadcast

_WHITE = r"\t-\r \xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: A whole run of white space with what follows it, up to the next; of that, letters that ASCII punctuation
#: follows are a part of their own, as the pre-tokenizer always cuts between the two.
PART = re.compile(
    rf"[{_WHITE}]*+[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]++(?=[!-/:-@\[-`{{-~])|[{_WHITE}]*+[^{_WHITE}]++|[{_WHITE}]++"
)
#: Signs that some take for white space and others don't: texts with any are encoded in one piece.
UNSETTLED = "\x1C\x1D\x1E\x1F\x85\u180E\u200B"
#: Parts that are encoded as one text, with a special token between them.
JOINED_PARTS = 200
#: Parts in each of the two generations that an encoder keeps, if not told otherwise; when the younger is
#: full, the older goes, so parts that are met again stay.  A worker that packs slices of 8 MB takes 485 MB
#: with 500 000 and 400 MB with 100 000; with slices of 2 MB and 100 000 it takes 250 MB, for more CPU time.
KEPT_PARTS = 500_000

#: The encoders of this worker, by the broadcast definition they come from.
_encoders: "WeakKeyDictionary[Broadcast, Encoder]" = WeakKeyDictionary()


class Encoder:
    def __init__(self, definition: str, kept_parts: int | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        added = self.tokenizer.get_added_tokens_decoder()
        # Strings of special tokens may hold anything, so texts with any are encoded in one piece as well.
        self.special = [t.content for t in added.values() if t.content]
        #: A special token that takes nothing of what is beside it, or none: (id, content).
        plain = [(n, t.content) for n, t in added.items() if t.content and t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.between = min(plain, default=None)
        self.kept_parts = KEPT_PARTS if kept_parts is None else kept_parts
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def parts(self, text: str) -> list[str]:
        """The pieces whose ids are put together to those of the text."""
        if any(sign in text for sign in UNSETTLED) or any(special in text for special in self.special):
            return [text]
        return PART.findall(text)

    def learn(self, new: list[str]) -> None:
        """Encodes parts.  Most of a short call's time is not the part's, so many go in one text; special
        tokens cut a text before all else, so the ids between two are those of the part alone."""
        alone = [part for part in new if any(special in part for special in self.special)]
        joined = list(set(new).difference(alone)) if alone else new
        for begin in range(0, len(joined), JOINED_PARTS):
            some = joined[begin : begin + JOINED_PARTS]
            if self.between is None:
                alone += some
                continue
            number, content = self.between
            found = self.tokenizer.encode_batch_fast([content.join(some)], add_special_tokens=False)[0]
            ids = np.asarray(found.ids, dtype="<u4")
            cuts = 4 * np.flatnonzero(ids == number)
            if len(cuts) != len(some) - 1:
                alone += some
                continue
            raw = ids.tobytes()
            for part, a, b in zip(some, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)]):
                self.known[part] = raw[a:b]
        for begin in range(0, len(alone), JOINED_PARTS):
            some = alone[begin : begin + JOINED_PARTS]
            for part, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.known[part] = np.asarray(found.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, ``end_id`` last; null counts as empty."""
        parts = [self.parts(text) if text else [] for text in texts]
        if len(self.known) > self.kept_parts:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for part in set(chain.from_iterable(parts)).difference(known):
            if part in older:
                known[part] = older[part]
            else:
                new.append(part)
        self.learn(new)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        return [b"".join(map(known.__getitem__, own)) + end for own in parts]


def encoder(definition: str) -> Encoder:
    return Encoder(definition)


def encoder_of(shipped: Broadcast, kept_parts: int | None = None) -> Encoder:
    """This worker's encoder for a broadcast definition; workers outlive a task, and so does what it has learned.

    A worker drops a broadcast when a task comes that doesn't use it; the encoder goes with it, so it takes
    no memory from the steps that follow.
    """
    if shipped not in _encoders:
        _encoders[shipped] = Encoder(shipped.value, kept_parts)
    return _encoders[shipped]


def definition(path: str) -> str:
    """Content of a vocabulary file, read once on the driver and sent to the tasks (1.5 MB)."""
    with open(path, encoding="utf-8") as file:
        return file.read()
