"""The published English (Porter2) suffix stemmer, working on regions of a word."""

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_BEFORE_LI = "cdeghkmnrt"

# The published exception lists and suffix tables.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
REGION_PREFIXES = ("gener", "commun", "arsen")
STEP_TWO = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
STEP_THREE = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP_FOUR = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
)


def _after(word: str, start: int) -> int:
    """Where the region begins that follows the first non-vowel after a vowel, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _regions(word: str) -> tuple:
    first = next((len(p) for p in REGION_PREFIXES if word.startswith(p)), None)
    first = _after(word, 0) if first is None else first
    return first, _after(word, first)


def _short_end(word: str) -> bool:
    """Ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS + "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _vowel_in(part: str) -> bool:
    return any(c in _VOWELS for c in part)


def _consonant_y(word: str) -> str:
    """A y at the start or after a vowel is written Y: it counts as no vowel."""
    out = []
    for i, c in enumerate(word):
        out.append("Y" if c == "y" and (i == 0 or out[-1] in _VOWELS) else c)
    return "".join(out)


def _plural(word: str) -> str:
    end = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return word[:-2]
    if end in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    return word[:-1] if end == "s" and _vowel_in(word[:-2]) else word


def _past(word: str, first: int) -> str:
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return word
    stem = word[: -len(end)]
    if end in ("eed", "eedly"):
        return stem + "ee" if len(stem) >= first else word
    if not _vowel_in(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem.endswith(_DOUBLES):
        return stem[:-1]
    return stem + "e" if len(stem) <= first and _short_end(stem) else stem


def _derived(word: str, first: int, second: int) -> str:
    end = _longest(word, STEP_TWO)
    if end is not None and len(word) - len(end) >= first:
        stem = word[: -len(end)]
        fits = {"ogi": stem.endswith("l"), "li": stem[-1:] in tuple(_BEFORE_LI)}.get(end, True)
        word = stem + STEP_TWO[end] if fits else word
    end = _longest(word, STEP_THREE)
    if end is not None and len(word) - len(end) >= (second if end == "ative" else first):
        word = word[: -len(end)] + STEP_THREE[end]
    end = _longest(word, STEP_FOUR)
    if end is not None and len(word) - len(end) >= second and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    return word


def snowball_stem(word: str) -> str:
    """Stem of a lower-cased word; words of one or two letters stay as they are."""
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in SPECIAL:
        return SPECIAL[word]
    word = _consonant_y(word)
    first, second = _regions(word)
    word = next((word.removesuffix(e) for e in ("'s'", "'s", "'") if word.endswith(e)), word)
    word = _plural(word)
    if word in KEPT_AFTER_PLURAL:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    word = _derived(word, first, second)
    if word.endswith("e"):
        if len(word) - 1 >= second or (len(word) - 1 >= first and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.replace("Y", "y")
