"""Porter's stemming steps (1980) for English words in lower case."""

from __future__ import annotations

import re

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_MORE0 = re.compile(f"^({_C})?{_V}{_C}")
_ONE = re.compile(f"^({_C})?{_V}{_C}({_V})?$")
_MORE1 = re.compile(f"^({_C})?{_V}{_C}{_V}{_C}")
_VOWEL = re.compile(f"^({_C})?[aeiouy]")
_CVC = re.compile("^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$")
_TWO = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log")
_THREE = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_FOUR = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii():
        return w
    w = re.sub("^y", "Y", w)
    w = re.sub("sses$", "ss", re.sub("ies$", "i", w)) if re.search("(ss|i)es$", w) else re.sub("([^s])s$", r"\1", w)
    if w.endswith("eed"):
        w = w[:-1] if _MORE0.match(w[:-3]) else w
    elif (m := re.match("(.+?)(ed|ing)$", w)) and _VOWEL.match(m[1]):
        w = m[1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"([^aeiouylsz])\1$", w):
            w = w[:-1]
        elif _CVC.match(w):
            w += "e"
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    for table in (_TWO, _THREE):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                w = w[: -len(end)] + table[end] if _MORE0.match(w[: -len(end)]) else w
                break
    for end in sorted(_FOUR, key=len, reverse=True):
        if w.endswith(end):
            w = w[: -len(end)] if _MORE1.match(w[: -len(end)]) else w
            break
    else:
        if re.search("[st]ion$", w) and _MORE1.match(w[:-3]):
            w = w[:-3]
    if w.endswith("e") and (_MORE1.match(w[:-1]) or (_ONE.match(w[:-1]) and not _CVC.match(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _MORE1.match(w):
        w = w[:-1]
    return w.lower()
