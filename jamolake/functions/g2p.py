"""Rule-based pronunciation of Hangul text as one map over adjacent syllables.

Each rule reads the final of a syllable and the initial of the next, and writes only these two, so
no rule's result is read by another: all pairs can be looked at side by side, without a loop.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column

from ._flat import letterwise
from .hangul import FINALS, FIRST, INITIALS, LAST

# The parts of compound finals, and (final, next initial) pairs that change.
SPLIT = {"ㄳ": "ㄱㅅ", "ㄵ": "ㄴㅈ", "ㄶ": "ㄴㅎ", "ㄺ": "ㄹㄱ", "ㄻ": "ㄹㅁ", "ㄼ": "ㄹㅂ", "ㄽ": "ㄹㅅ", "ㄾ": "ㄹㅌ", "ㄿ": "ㄹㅍ", "ㅀ": "ㄹㅎ", "ㅄ": "ㅂㅅ"}
ASPIRATED = {"ㅎㄱ": "ㅋ", "ㅎㄷ": "ㅌ", "ㅎㅈ": "ㅊ", "ㅎㅅ": "ㅅ", "ㄱㅎ": "ㅋ", "ㄷㅎ": "ㅌ", "ㅂㅎ": "ㅍ", "ㅈㅎ": "ㅊ"}
NASAL = {"ㄱㄴ": "ㅇㄴ", "ㄱㅁ": "ㅇㅁ", "ㄷㄴ": "ㄴㄴ", "ㄷㅁ": "ㄴㅁ", "ㅂㄴ": "ㅁㄴ", "ㅂㅁ": "ㅁㅁ", "ㄱㄹ": "ㅇㄴ", "ㄷㄹ": "ㄴㄴ", "ㅂㄹ": "ㅁㄴ"}
PALATAL = {"ㄷ": "ㅈ", "ㅌ": "ㅊ"}


def pair_rules() -> dict[int, tuple[int, int]]:
    """(final number * 19 + initial number) to the new (final, initial) numbers: linking before a
    silent initial first, then aspiration, then nasalisation."""
    rules = {}
    for f in FINALS[1:]:
        stays, moves = SPLIT.get(f, f" {f}")
        rules[f, "ㅇ"] = (stays, moves)
    for pair, new in ASPIRATED.items():
        rules.setdefault(tuple(pair), (" ", new))
    for pair, new in NASAL.items():
        rules.setdefault(tuple(pair), tuple(new))
    return {FINALS.index(f) * 19 + INITIALS.index(i): (FINALS.index(a), INITIALS.index(b)) for (f, i), (a, b) in rules.items()}


RULES = pair_rules()


#: The new (final, initial) numbers at final number * 19 + initial number, those given where no rule holds.
_ALL = [RULES.get(k, divmod(k, len(INITIALS))) for k in range(len(FINALS) * len(INITIALS))]


_FINAL, _INITIAL = (np.array([v[side] for v in _ALL]) for side in (0, 1))


def _spoken(palatalize: bool):
    def change(codes, place, row):
        inside = (codes >= FIRST) & (codes <= LAST)
        k = np.where(inside, codes - FIRST, 0)
        opened, vowel, closed = k // 588, k % 588 // 28, k % 28
        # pairs of neighbours of one text, both syllables
        at = np.flatnonzero(inside[:-1] & inside[1:] & (row[:-1] == row[1:]))
        pair = closed[at] * len(INITIALS) + opened[at + 1]
        initial, final = opened.copy(), closed.copy()
        final[at], initial[at + 1] = _FINAL[pair], _INITIAL[pair]
        if palatalize:
            for f, new in PALATAL.items():
                soft = at[(pair == FINALS.index(f) * len(INITIALS) + INITIALS.index("ㅇ")) & (vowel[at + 1] == 20)]
                initial[soft + 1] = INITIALS.index(new)
        return np.where(inside, FIRST + initial * 588 + vowel * 28 + final, codes), np.ones(len(codes), dtype=np.int64)

    return letterwise(change)


_PLAIN, _PALATALIZED = _spoken(False), _spoken(True)


def g2p(text: Column, palatalize: bool = False) -> Column:
    """The pronunciation of a text. Anything but a syllable, a space too, parts the pairs. With
    palatalize, ㄷ and ㅌ before 이 turn into ㅈ and ㅊ when they link, which the plain rules never
    reach."""
    return (_PALATALIZED if palatalize else _PLAIN)(text)
