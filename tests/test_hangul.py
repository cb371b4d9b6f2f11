import random

from pyspark.sql import functions as F

from jamolake.functions import hangul as h
from jamolake.functions.g2p import g2p

PHRASES = ["가치 해볼까", "좋네요", "먹어요", "안녕하세요", "같이 해볼까", "닭볶음탕", "앉아서", "읽었다", "천천히 말해주세요", "저는 잘 들리지 않아요"]
SPOKEN = {
    "같이 해볼까": "가티 해볼까", "좋네요": "좋네요", "안녕하세요": "안녕하세요", "먹어요": "머거요", "닭볶음": "닭보끔", "천천히 말해주세요": "천천히 말해주세요",
    "오늘 날씨가 좋네요": "오늘 날씨가 좋네요", "맛있는 음식": "마싰는 음식", "국물이 끓고 있어요": "궁무리 끓고 이써요", "학교에 갑니다": "학교에 감니다", "좋아": "조하", "않아": "안하", "강아지": "가아지", "": "", "a1 ": "a1 ",
}


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows)]


def test_round_trip(spark):
    assert column(spark, PHRASES, lambda v: h.jamo_to_syllable(h.syllable_to_jamo(v))) == PHRASES


def test_letters(spark):
    assert column(spark, PHRASES[:3], h.syllable_to_jamo) == ["ㄱㅏㅊㅣ|ㅎㅐㅂㅗㄹㄲㅏ", "ㅈㅗㅎㄴㅔㅇㅛ", "ㅁㅓㄱㅇㅓㅇㅛ"]
    assert column(spark, ["닭 a", "", None], h.jamo_string) == ["ㄷㅏㄺ a", "", None]
    assert column(spark, ["닭 a"], h.syllable_groups) == [[["ㄷ", "ㅏ", "ㄺ"], [" "], ["a"]]]


def plain_recompose(jamo):
    """Letter by letter: a syllable takes a final only if no vowel comes after it."""
    words = []
    for w in jamo.replace("|", " ").split(" "):
        out, k = "", 0
        while k < len(w):
            if w[k] in h.INITIALS and k + 1 < len(w) and w[k + 1] in h.VOWELS:
                final = k + 2 < len(w) and w[k + 2] in h.FINALS.strip() and not (k + 3 < len(w) and w[k + 3] in h.VOWELS)
                out += chr(h.FIRST + h.INITIALS.index(w[k]) * 588 + h.VOWELS.index(w[k + 1]) * 28 + (h.FINALS.index(w[k + 2]) if final else 0))
                k += 3 if final else 2
            else:
                out += chr(h.FIRST + 11 * 588 + h.VOWELS.index(w[k]) * 28) if w[k] in h.VOWELS else w[k]
                k += 1
        words += [out] if w else []
    return " ".join(words)


def test_recomposition(spark):
    cases = {"ㄱㅏㄳㅏ": "가ㄳ아", "ㄱㅏㄸ": "가ㄸ", "ㅏ||ㄱ": "아 ㄱ", "": "", None: None}
    assert column(spark, list(cases), h.jamo_to_syllable) == list(cases.values())
    rng = random.Random(3)
    texts = ["".join(rng.choice("ㄱㄷㄸㅇㅎㅏㅣㅢㄳㅄ| a\n\U0001f600가") for _ in range(rng.randrange(40))) for _ in range(300)]
    assert column(spark, texts, h.jamo_to_syllable) == [plain_recompose(x) for x in texts]


def test_joined_letters(spark):
    assert column(spark, ["닭 a 가", " ", None], h.joined_letters) == ["ㄷㅏㄺaㄱㅏ", "", None]


def test_vocabulary(spark):
    assert len(h.VOCABULARY) == 56 and h.VOCABULARY["ㄱ"] == 5 and h.VOCABULARY["ㅣ"] == 44 and h.VOCABULARY["ㅄ"] == 55
    assert column(spark, ["ㄱ|x"], h.encode) == [[5, 4, 3]]
    assert column(spark, ["ㄱxx|y"], h.out_of_vocabulary) == [["x", "y"]]


def test_pronunciation(spark):
    assert column(spark, list(SPOKEN), g2p) == list(SPOKEN.values())
    assert column(spark, ["같이", "굳이"], lambda v: g2p(v, palatalize=True)) == ["가치", "구지"]


def test_decompose(spark):
    assert [r and tuple(r) for r in column(spark, ["닭", "가", "a", None], h.decompose)] == [("ㄷ", "ㅏ", "ㄺ"), ("ㄱ", "ㅏ", None), None, None]
