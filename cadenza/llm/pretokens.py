"""Splitting texts into the pieces that byte-level BPE merges work in.

The pieces are the matches of ``public_tokenizers.PATTERN``: contractions,
letters, numbers and other characters with at most one space before, and
white space.  ``split_many`` finds them for a batch of texts with numpy, from
where the character class changes.

A long text is split by halves and joined: pieces near the end of the left
half may have seen the end of the text, so a window that begins at the first
of these is split again, into the right half, and grows until one of its cuts
is a cut of the right half.  The pattern never looks back, so from there on
the right half's pieces hold.
"""

from __future__ import annotations

import numpy as np

from .common import worker_cache

#: Texts up to this many characters are split in one go.
LEAF = 1 << 16
#: The longest match of the pattern that looks at a fixed number of characters
#: ('re, 've, 'll) decides on two characters after its first.
SLACK = 2
_SPACE, _LETTER, _NUMBER, _OTHER, _BREAK = 0, 1, 2, 3, 9


def _classes() -> np.ndarray:
    cache = worker_cache("classes")
    if "c" not in cache:
        import regex
        # every character at once: a list of them would be some 120 MB of a worker
        points = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")])
        every = points.tobytes().decode("utf-32-le")
        table = np.full(0x110000, _OTHER, np.uint8)
        shift = 0xE000 - 0xD800
        for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                a, b = (x + shift if x >= 0xD800 else x for x in m.span())
                table[a:b] = kind
        cache["c"] = table
    return cache["c"]


def _segment(texts: list[str]) -> list[list[str]]:
    """Pieces of each text, whole."""
    line = "\n".join(texts) + "\n"
    code = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    kind = _classes()[code]
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind[stops] = _BREAK
    n = len(code)
    cut = np.zeros(n + 3, bool)
    cut[0] = True
    cut[1:n] = kind[1:] != kind[:-1]
    starts = np.flatnonzero(cut[:n])
    ends = np.append(starts[1:], n)
    # the last of some white space before a word: a space joins the word,
    # any other character is a piece of its own
    last = np.flatnonzero((kind[starts] == _SPACE) & (kind[np.minimum(ends, n - 1)] != _BREAK))
    last = ends[last] - 1
    cut[last] = True
    cut[last[code[last] == 32] + 1] = False
    cut[stops] = True
    cut[stops + 1] = True
    # contractions: an apostrophe that begins a piece, with lower-case letters after it
    quote = np.flatnonzero((code == 39) & cut[:n])
    if len(quote):
        wide = np.append(code, [0, 0])
        one, two = wide[quote + 1], wide[quote + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) \
            | ((one == ord("l")) & (two == ord("l")))
        for at, size in ((quote[single], 1), (quote[double], 2)):
            cut[at + 1] = False
            cut[at + 1 + size] = True
    at = np.flatnonzero(cut[: n + 1])
    index = at.tolist()
    pieces = [line[a:b] for a, b in zip(index, index[1:])]
    out, first = [], 0
    for stop in np.searchsorted(at, stops).tolist():
        out.append(pieces[first:stop])
        first = stop + 1
    return out


def _join(left: list[str], right: list[str]) -> list[str]:
    """Pieces of the joined text from the pieces of its two parts."""
    kept, tail = list(left), ""
    while kept and len(tail) < SLACK:
        tail = kept.pop() + tail
    cuts, total = {}, 0
    for i, piece in enumerate(right):
        cuts[total] = i
        total += len(piece)
    head, taken, width = [], 0, 64
    while True:
        while taken < len(right) and sum(map(len, head)) < width:
            head.append(right[taken])
            taken += 1
        window = tail + "".join(head)
        pieces = _segment([window])[0]
        if taken == len(right):
            return kept + pieces
        end = -len(tail)
        for j, piece in enumerate(pieces):
            if end > 0 and end in cuts:
                return kept + pieces[:j] + right[cuts[end]:]
            end += len(piece)
            if end + SLACK > len(window) - len(tail):
                break       # from here on a piece may have seen the window's end
        width *= 2


def _tree(text: str) -> list[str]:
    if len(text) <= LEAF:
        return _segment([text])[0]
    half = len(text) // 2
    return _join(_tree(text[:half]), _tree(text[half:]))


def split_many(texts: list[str]) -> list[list[str]]:
    """The pieces of each text; none for an empty text."""
    short = [t if len(t) <= LEAF else "" for t in texts]
    out, group, size = [], [], 0
    for text in short:
        group.append(text)
        size += len(text)
        if size > 8 * LEAF:
            out += _segment(group)
            group, size = [], 0
    if group:
        out += _segment(group)
    return [pieces if len(t) <= LEAF else _tree(t) for t, pieces in zip(texts, out)]
