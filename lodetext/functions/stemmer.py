"""Porter's stemming algorithm (Porter, 1980) with the common extensions for short and irregular words."""

from __future__ import annotations

VOWELS = frozenset("aeiou")
#: Words with a stem of their own.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
#: Suffixes of steps 2, 3 and 4 of the paper.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(word: str) -> str:
    """A letter c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in VOWELS or c == "y" and out[-1:] == "c" else "c"
    return out


def measure(stem: str) -> int:
    """Number of vowel-consonant turns."""
    return shape(stem).count("vc")


def has_vowel(stem: str) -> bool:
    return "v" in shape(stem)


def short_end(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    s = shape(stem)
    return s[-3:] == "cvc" and stem[-1] not in "wxy" or s == "vc"


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    # plurals
    if word.endswith("ies"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past tense and gerund
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and has_vowel(word[: -len(s)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                word = cut + "e"
            elif len(cut) > 1 and cut[-1] == cut[-2] and shape(cut)[-1] == "c":
                word = cut if cut[-1] in "lsz" else cut[:-1]
            elif measure(cut) == 1 and short_end(cut):
                word = cut + "e"
            else:
                word = cut
    if word.endswith("y") and len(word) > 2 and shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    # derivations
    for table in (STEP2, STEP3):
        found = longest(word, [s for s, _ in table])
        if found:
            base = word[: -len(found)]
            if measure(base + "l" if found == "logi" else base) > 0:
                word = base + dict(table)[found]
                if found == "alli":  # what remains may end in another one
                    again = longest(word, [s for s, _ in table])
                    if again and measure(word[: -len(again)]) > 0:
                        word = word[: -len(again)] + dict(table)[again]
    found = longest(word, STEP4)
    if found:
        base = word[: -len(found)]
        if measure(base) > 1 and (found != "ion" or base[-1:] in ("s", "t")):
            word = base
    # tidying
    if word.endswith("e"):
        base = word[:-1]
        if measure(base) > 1 or measure(base) == 1 and not short_end(base):
            word = base
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word
