"""The rules once more in plain Python, for small inputs."""

import re

TFN = (1, 4, 3, 7, 5, 8, 6, 9, 10)
ABN = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
MEDICARE = (1, 3, 7, 9, 1, 3, 7, 9)


def weigh(digits, weights):
    return sum(int(d) * w for d, w in zip(digits, weights))


def checksum(entity, text):
    d = re.sub("[^0-9]", "", text)
    if entity == "AU_TFN":
        return weigh(d, TFN) % 11 == 0
    if entity == "AU_ABN":
        return (weigh(d, ABN) - 10) % 89 == 0
    if entity == "AU_MEDICARE":
        return d[8] != "0" and weigh(d, MEDICARE) % 10 == int(d[9])
    if entity == "IP_ADDRESS":
        return all(int(o) < 256 for o in text.split("."))
    return True


def find(text, recognizers):
    """(entity, start, end, base or validated score, place)"""
    spans = []
    for place, r in enumerate(recognizers):
        pattern, score = r.patterns[0]
        if r.entity == "EMAIL_ADDRESS":
            pattern = r"\b(?:[^\W]|[.%+-])+@(?:[^\W_]|[.-])+\.(?:[A-Za-z]|[^\W\x00-\x7f])" + r"{2,}\b"
        else:
            pattern = pattern.replace(r"\d", "[0-9]")
        for m in re.finditer(pattern, text):
            if checksum(r.entity, m.group()):
                spans.append((r.entity, m.start(), m.end(), 1.0 if r.validator else score, place))
    return spans


def resolve(spans):
    def beaten(x):
        for y in spans:
            if y[1] <= x[1] and y[2] >= x[2]:
                if y[1:3] != x[1:3] or y[3] > x[3] or (y[3] == x[3] and y[4] < x[4]):
                    return True
        return False
    return sorted((x for x in spans if not beaten(x)), key=lambda s: s[1])


def merge(text, spans):
    out = []
    for s in spans:
        if out and out[-1][0] == s[0] and re.fullmatch(" +", text[out[-1][2]:s[1]]):
            last = out.pop()
            s = (s[0], last[1], s[2], max(last[3], s[3]), s[4])
        out.append(s)
    return out


def mask(text, spans, placeholders):
    """Right to left; each span ends where the one to its right starts."""
    limit = len(text)
    for entity, start, end, _, _ in reversed(merge(text, resolve(spans))):
        text = text[:start] + placeholders.get(entity, "") + text[min(end, limit):]
        limit = start
    return text
