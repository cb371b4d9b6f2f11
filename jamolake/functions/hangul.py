"""Hangul letters (jamo) as Column expressions: decomposition, composition, vocabulary."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._flat import letterwise

# The letters in the order of the syllable block of Unicode; a blank final is none.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
COMPOUND_FINALS = "ㄳㄵㄶㄺㄻㄼㄽㄾㄿㅀㅄ"
SPECIAL_TOKENS = ["<pad>", "<s>", "</s>", "<unk>", "|"]
FIRST, LAST = 0xAC00, 0xD7A3

#: 56 tokens: the special ones, then initials, vowels and compound finals.
VOCABULARY = {t: i for i, t in enumerate([*SPECIAL_TOKENS, *INITIALS, *VOWELS, *COMPOUND_FINALS])}
UNKNOWN = VOCABULARY["<unk>"]


def chars(text: Column) -> Column:
    """The characters of a text; none for an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def is_syllable(code: Column) -> Column:
    return code.between(FIRST, LAST)


def initial_of(code: Column) -> Column:
    return F.floor((code - FIRST) / 588).cast("int")


def vowel_of(code: Column) -> Column:
    return F.floor((code - FIRST) % 588 / 28).cast("int")


def final_of(code: Column) -> Column:
    return ((code - FIRST) % 28).cast("int")


def letter(table: str, index: Column) -> Column:
    return F.substring(F.lit(table), index + 1, F.lit(1))


def character(code: Column) -> Column:
    """The character of a code point of four hexadecimal digits."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def compose(initial: Column, vowel: Column, final: Column) -> Column:
    """The syllable of three letter numbers (final 0 is none)."""
    return character(FIRST + initial * 588 + vowel * 28 + final)


def decompose(char: Column) -> Column:
    """struct<initial, vowel, final> of letters, final null if none; null unless a syllable."""
    code = F.ascii(char)
    return F.when(is_syllable(code), F.struct(letter(INITIALS, initial_of(code)).alias("initial"), letter(VOWELS, vowel_of(code)).alias("vowel"), F.when(final_of(code) > 0, letter(FINALS, final_of(code))).alias("final")))


def syllable(place: Column) -> Column:
    """The syllable at a place of the block, from 0; null outside of it. One look into a fixed array, for whole texts."""
    return F.get(F.split(F.lit(",".join(map(chr, range(FIRST, LAST + 1)))), ","), place)


_OF_SYLLABLES = ",".join(INITIALS[k // 588] + VOWELS[k % 588 // 28] + FINALS[k % 28].strip() for k in range(LAST - FIRST + 1))


def _letters(char: Column) -> Column:
    """The letters of a syllable, null of anything else."""
    return F.get(F.split(F.lit(_OF_SYLLABLES), ","), F.ascii(char) - FIRST)


_JAMO = np.array([[ord(INITIALS[k // 588]), ord(VOWELS[k % 588 // 28]), ord(FINALS[k % 28])] for k in range(LAST - FIRST + 1)])


@letterwise
def _jamo_string(codes, place, row):
    inside = (codes >= FIRST) & (codes <= LAST)
    found = np.zeros((len(codes), 3), dtype=np.int64)
    found[:, 0] = codes
    found[inside] = _JAMO[codes[inside] - FIRST]
    there = np.ones((len(codes), 3), dtype=bool)
    there[:, 1] = inside
    there[:, 2] = inside & (found[:, 2] != ord(" "))
    return found[there], there.sum(axis=1)


def jamo_string(text: Column) -> Column:
    """Letters of the syllables; everything else, spaces included, as it is. All letters of a batch are looked up at
    once, where built-in functions of arrays go letter by letter."""
    return _jamo_string(text)


def text_to_jamo(text: Column) -> Column:
    """The letters of jamo_string as an array."""
    return chars(jamo_string(text))


def syllable_to_jamo(text: Column) -> Column:
    """Letters of the syllables, a bar for each space, and nothing for the rest."""
    return F.array_join(F.transform(chars(text), lambda c: F.when(c == " ", "|").otherwise(F.coalesce(_letters(c), F.lit("")))), "")


def joined_letters(text: Column) -> Column:
    """jamo_string() of a text without its spaces."""
    return jamo_string(F.replace(text, F.lit(" "), F.lit("")))


def syllable_groups(text: Column) -> Column:
    """Arrays of letters word by word, with [' '] between words."""
    # the letters of words, as spaces stay what they are
    words = F.split(jamo_string(text), " ")
    return F.flatten(F.transform(words, lambda w, i: F.when(i > 0, F.array(F.array(F.lit(" ")), chars(w))).otherwise(F.array(chars(w)))))


#: A syllable (a consonant right before a vowel is no final), or any other single letter.
_SYLLABLE = f"(?s)[{INITIALS}][{VOWELS}](?:[{FINALS.strip()}](?![{VOWELS}]))?|."


def _syllable(letters: Column) -> Column:
    at = lambda k, alphabet: F.position(F.substr(letters, F.lit(k), F.lit(1)), F.lit(alphabet)) - 1
    n = F.length(letters)
    return F.when(n > 1, compose(at(1, INITIALS), at(2, VOWELS), F.when(n > 2, at(3, FINALS)).otherwise(0))).when(at(1, VOWELS) >= 0, compose(F.lit(INITIALS.index("ㅇ")), at(1, VOWELS), F.lit(0))).otherwise(letters)


def jamo_to_syllable(jamo: Column) -> Column:
    """A letter sequence as syllables: a consonant before a vowel opens the next syllable, a lone
    vowel takes a silent initial, other letters stand alone; bars and spaces part words, and empty
    words go."""
    words = F.filter(F.split(F.translate(jamo, "|", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(_SYLLABLE), F.lit(0)), _syllable), "")), " ")


def _vocabulary_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in VOCABULARY.items() for x in kv])


def numbers(values: list[int]) -> Column:
    """A fixed array of whole numbers, as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


#: The token's number of each code point from the first single letter on.
_LETTER = min(ord(t) for t in INITIALS + VOWELS)
_TOKENS = [VOCABULARY.get(chr(k), UNKNOWN) for k in range(_LETTER, max(ord(t) for t in INITIALS + VOWELS + COMPOUND_FINALS) + 1)]


def encode(text: Column) -> Column:
    """Token numbers of the characters; unknown ones get the unknown token's."""
    return F.transform(chars(text), lambda c: F.when(c == "|", VOCABULARY["|"]).otherwise(F.coalesce(F.get(numbers(_TOKENS), F.ascii(c) - _LETTER), F.lit(UNKNOWN))))


def out_of_vocabulary(text: Column) -> Column:
    return F.array_except(chars(text), F.map_keys(_vocabulary_map()))
