"""Independent pure-Python model of the hash / xorshift128 / generator
semantics, used only by the tests as a second opinion on the Spark
expressions (not imported by the library)."""

from __future__ import annotations

M31 = 0x7FFFFFFF


def i32(v):
    v &= 0xFFFFFFFF
    return v - (1 << 32) if v >= (1 << 31) else v


def utf16_units(s):
    for ch in s:
        cp = ord(ch)
        if cp >= 0x10000:
            cp -= 0x10000
            yield 0xD800 + (cp >> 10)
            yield 0xDC00 + (cp & 0x3FF)
        else:
            yield cp


def js_hash(s):
    h = 5381
    for u in utf16_units(s):
        h = (h * 33 + u) & M31
    return h or 1


class Rng:
    def __init__(self, seed):
        s = abs(int(seed)) % M31 or 1
        self.st = [s, i32(s ^ 0x12345678), i32(s ^ 0x87654321), i32(s ^ 0xABCDEF01)]
        for _ in range(10):
            self.next()

    def next(self):
        t = self.st[3]
        s = self.st[0]
        self.st[3] = self.st[2]
        self.st[2] = self.st[1]
        self.st[1] = s
        t = i32(t ^ (t << 11))
        t = i32(t ^ ((t & 0xFFFFFFFF) >> 8))
        self.st[0] = i32(t ^ s ^ ((s & 0xFFFFFFFF) >> 19))
        return abs(self.st[0]) / M31

    def int(self, lo, hi):
        if lo == hi:
            return lo
        return int(self.next() * (hi - lo + 1)) + lo

    def chars(self, n, alpha):
        if n <= 0:
            return ""
        out = []
        for _ in range(n):
            i = self.int(0, len(alpha) - 1)
            out.append(alpha[i] if i < len(alpha) else "undefined")
        return "".join(out)

    def alnum(self, n):
        return self.chars(n, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")

    def hex(self, n):
        return self.chars(n, "abcdef0123456789")


def fake_email(m):
    return f"user{Rng(js_hash(m)).int(1000, 9999)}@example.com"


def preserve_shape(s):
    if not s:
        return "[REDACTED]"
    r = Rng(js_hash(s))
    out = []
    for ch in s:
        if "a" <= ch <= "z":
            out.append(r.chars(1, "abcdefghijklmnopqrstuvwxyz"))
        elif "A" <= ch <= "Z":
            out.append(r.chars(1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        elif "0" <= ch <= "9":
            out.append(r.chars(1, "0123456789"))
        else:
            out.append(ch)
    return "".join(out) or "[REDACTED]"
