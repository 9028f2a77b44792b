"""Pseudonyms and quality scores written anew in plain Python, to hold the operators against."""

import datetime as dt
import hashlib
import re

import numpy as np
import regex

from auditframe.llm import privacy


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def plain_score(net, text):
    """The network's probability, symbol by symbol and chunk by chunk."""
    width, _, n = net.filters.shape
    raw = (text or "").encode()
    halves = max(1, -(-(len(raw) + width - 1) // 128))
    codes = np.r_[np.full(width - 1, 256), np.frombuffer(raw, dtype=np.uint8).astype(int)]
    codes = np.r_[codes, np.full(halves * 128 - len(codes), 256)]
    after = np.r_[codes, np.full(width, 256)]
    out = sum(net.filters[j][after[j : j + len(codes)]] for j in range(width)).reshape(halves, 128, n).max(axis=1)
    pooled = np.maximum(out + net.bias, 0)
    chunks = np.stack([pooled[i : i + 2].max(axis=0) for i in range(max(1, halves - 1))])
    return 1 / (1 + np.exp(-(np.r_[chunks.mean(axis=0), chunks.max(axis=0)] @ net.head[:-1] + net.head[-1])))


def pseudonymiser(key):
    """A function from a text to the text with pseudonyms: networks, checks and replacement."""

    def digest(kind, *parts):
        return hashlib.sha256(":".join([key, kind, *map(str, parts)]).encode()).hexdigest()

    def network(a, b, m, n, kind):
        for r in range(8):
            noise = int(digest(kind, r, m, n, a if r % 2 else b)[:15], 16)
            a, b = (a, (b + noise) % n) if r % 2 else ((a + noise) % m, b)
        return a, b

    def digits_of(d, kind):
        half = (len(d) + 1) // 2
        a, b = network(int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half), kind)
        return f"{a:0{half}d}{b:0{len(d) - half}d}"

    def put(value, d):
        it = iter(d)
        return "".join(next(it) if c.isdigit() else c for c in value)

    def mod97(v):
        return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97

    def new(kind, v, assigned):
        d = re.sub("[^0-9]", "", v)
        out = v
        if kind == "email":
            return "user" + digest("email", v.lower())[:32] + "@masked.invalid"
        if kind == "secret":
            out = secret(v)
        elif kind == "iban" and mod97(w := v.replace(" ", "")) == 1:
            account = put(w[4:], digits_of(re.sub("[^0-9]", "", w[4:]), "iban"))
            out = put(v, f"{98 - mod97(w[:2] + '00' + account):02d}" + re.sub("[^0-9]", "", account))
        elif kind == "ip":
            p = [int(x) for x in v.split(".")]
            a, b = network(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ip")
            out = f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
        elif kind == "date":
            order = {"-": "%Y-%m-%d", ".": "%d.%m.%Y", "/": "%m/%d/%Y"}[re.search("[./-]", v)[0]]
            try:
                day = (dt.datetime.strptime(v, order).date() - dt.date(1800, 1, 1)).days
            except ValueError:
                day = -1
            if 0 <= day < 146097:
                a, b = network(day // 773, day % 773, 189, 773, "date")
                new_day = dt.date(1800, 1, 1) + dt.timedelta(days=a * 773 + b)
                out = new_day.strftime(order)
                if "/" in v:
                    out = "/".join(f"{n:0{2 if len(was) == 2 else 1}d}" for n, was in zip((new_day.month, new_day.day, new_day.year), v.split("/"), strict=True))
        elif kind == "ssn":
            a, g, s = (int(x) for x in v.split("-"))
            if 0 < a < 900 and a != 666 and g and s:
                x, y = network(a - (2 if a > 666 else 1), (g - 1) * 9999 + s - 1, 898, 99 * 9999, "ssn")
                out = f"{x + (2 if x >= 665 else 1):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"
        elif kind == "phone":
            kept = max(len(d) - 10, 1 if v[0] == "+" else 0)
            out = put(v, d[:kept] + digits_of(d[kept:], "phone"))
        elif kind == "card":
            out = cards(v)
        return secret(v) if out == v and assigned else out

    def cards(v):
        numbers = re.findall("[0-9]+[ -]?", v)
        out, at = "", 0
        while at < len(numbers):
            for size in range(min(19, len(numbers) - at), 0, -1):
                run = "".join(numbers[at : at + size]).rstrip(" -")
                d = re.sub("[^0-9]", "", run)
                if 13 <= len(d) <= 19 and luhn(d) == 0:
                    body = digits_of(d[:-1], "card")
                    out += put(run, next(body + c for c in "0123456789" if luhn(body + c) == 0)) + "".join(numbers[at : at + size])[len(run) :]
                    at += size
                    break
            else:
                out, at = out + numbers[at], at + 1
        return out

    def secret(v):
        hexadecimal = re.fullmatch("[0-9A-Fa-f]{32,}", v)
        parts = [digest(f"secret{n}", v.lower() if hexadecimal else v) for n in range((len(v) - 1) // 64 + 1)]
        out = "".join(parts)[: len(v)]
        return out.upper() if hexadecimal and re.search("[A-F]", v) and not re.search("[a-f]", v) else out

    pattern = regex.compile("|".join(f"(?P<{k}>{v})" for k, v in privacy.KINDS.items()))
    shapes = [("email", "@"), ("secret", "[0-9A-Fa-f]{32,}|A[KS]IA[0-9A-Z]{16}"), ("iban", "[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,}"), ("ip", r"\d+(\.\d+){3}"), ("date", r"\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d{1,2}/\d{1,2}/\d{4}"), ("ssn", r"\d{3}-\d\d-\d{4}"), ("phone", r"\+[1-9]([ .-]?\d){7,14}|(\+[1-9]\d{0,2}[ .-]?)?(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"), ("card", r"\d([ -]?\d){12,199}")]

    def replaced(m):
        kind = m.lastgroup
        if kind == "assigned":
            kind = next((k for k, shape in shapes if re.fullmatch(shape, m[0])), "assigned")
        return new(kind, m[0], regex.search(f"(?:{privacy.ASSIGNS}|{privacy.BEARER})$", m.string[max(0, m.start() - 40) : m.start()]) is not None)

    return lambda text: pattern.sub(replaced, text) if text else text
