"""Small plain-Python models that the expressions are compared with."""

import re

MARK = "\n...[truncated]"


def tokens(text):
    text = text.strip()
    return max(len(re.findall(r"\w+|[^\w\s]", text)), len(text) // 4, 1) if text else 0


def clipped(text, most, marker=MARK):
    text = text.strip()
    n = tokens(text)
    if most <= 0 or n <= most:
        return text
    room = most - tokens(marker)
    if room <= 0:
        marker, room = "", most
    short = text[: max(1, int(len(text) * most / n))].rstrip()
    while tokens(short) > room:
        short = short[: max(0, len(short) - max(8, 3 * (tokens(short) - room)))].rstrip()
    return short + marker if short else marker.strip()


def chars(text, most, marker=MARK):
    text = text.strip()
    if most <= 0 or len(text) <= most:
        return text
    return text[:most] if most <= len(marker) else text[: most - len(marker)].rstrip() + marker


def fitting(texts, rows, chunk_chars, total_chars, chunk_tokens=0, total_tokens=0):
    out = []
    for i, raw in enumerate(texts):
        used, spent = sum(len(t) for _, t in out), sum(tokens(t) for _, t in out)
        if (rows > 0 and len(out) == rows) or (total_chars > 0 and used >= total_chars) or (total_tokens > 0 and spent >= total_tokens):
            break
        text = clipped(chars(raw or "", chunk_chars), chunk_tokens)
        text = chars(text, total_chars - used, "") if total_chars > 0 else text
        text = clipped(text, total_tokens - spent, "") if total_tokens > 0 else text
        if text:
            out.append((i, text))
    return out


def greedy(units, most, glue):
    groups = []
    for u in units:
        if groups and (most <= 0 or len(glue.join([*groups[-1], u])) <= most):
            groups[-1].append(u)
        else:
            groups.append([u])
    return groups


def packed(units, target, least, sentences):
    flat = []
    for u in units:
        parts = sentences(u) if 0 < target < len(u) else []
        flat += [" ".join(g) for g in greedy(parts, target, " ")] if len(parts) > 1 else [u]
    out = []
    for g in greedy(flat, target, "\n\n"):
        text = "\n\n".join(g)
        if out and len(text) < least:
            out[-1] += "\n\n" + text
        else:
            out.append(text)
    return out
