"""Sequential statements of the rules, to check the column expressions against."""

import re

from veilframe.catalog.sqlparts import RE2

PATTERNS = [(c, re.compile(p)) for c, p in RE2]


def spans(text):
    found = [
        (m.start(), m.start() - m.end(), rank, m.end(), category, m.group())
        for rank, (category, pattern) in enumerate(PATTERNS)
        for m in pattern.finditer(text)
    ]
    kept, last = [], -1
    for start, _, _, end, category, value in sorted(found):
        if start >= last:
            kept.append((category, start, end, value))
            last = end
    return kept


def splice(text, edits):
    for start, end, token in sorted(edits, reverse=True):
        text = text[:start] + token + text[end:]
    return text


def bioes(tokens):
    """tokens: (prefix, category, offsets or None, prob)."""
    out, i = [], 0
    while i < len(tokens):
        prefix, category, offsets, prob = tokens[i]
        j = i + 1
        if prefix == "S":
            if offsets not in (None, (0, 0)):
                out.append((category, offsets[0], offsets[1], prob))
        elif prefix == "B":
            probs = [prob]
            while j < len(tokens) and tokens[j][1] == category and tokens[j][0] in "IE":
                probs.append(tokens[j][3])
                j += 1
                if tokens[j - 1][0] == "E":
                    break
            last = tokens[j - 1][2]
            if offsets not in (None, (0, 0)) and last is not None:
                out.append((category, offsets[0], last[1], sum(probs) / len(probs)))
        i = j
    return out
