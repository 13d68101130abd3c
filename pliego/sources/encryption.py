"""PDF encryption with a password: AES-256, revision 6 of the standard handler."""

from __future__ import annotations

import hashlib
import os
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _tables() -> tuple[bytes, list[list[int]]]:
    """The substitution box, from inverses in GF(2^8), and its four column tables."""
    log, power, x = [0] * 256, [0] * 255, 1
    for k in range(255):
        power[k], log[x] = x, k
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)  # times 3
        x &= 0xFF
    box = bytearray(256)
    for v in range(256):
        b = power[-log[v] % 255] if v else 0
        box[v] = b ^ 0x63
        for r in range(1, 5):
            box[v] ^= (b << r | b >> (8 - r)) & 0xFF
    twice = lambda b: (b << 1 ^ (0x11B if b & 0x80 else 0)) & 0xFF
    first = [twice(s) << 24 | s << 16 | s << 8 | (twice(s) ^ s) for s in box]
    return bytes(box), [[t >> 8 * r | (t << (32 - 8 * r)) & 0xFFFFFFFF for t in first] for r in range(4)]


def _schedule(key: bytes) -> list[int]:
    box, _ = _tables()
    n = len(key) // 4
    w, round_ = [int.from_bytes(key[4 * i : 4 * i + 4], "big") for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        t = w[-1]
        if i % n == 0:
            t = int.from_bytes(bytes(box[b] for b in (t << 8 & 0xFFFFFFFF | t >> 24).to_bytes(4, "big")), "big") ^ round_ << 24
            round_ = round_ << 1 ^ (0x11B if round_ & 0x80 else 0)
        elif n > 6 and i % n == 4:
            t = int.from_bytes(bytes(box[b] for b in t.to_bytes(4, "big")), "big")
        w.append(w[i - n] ^ t)
    return w


def cbc(key: bytes, iv: bytes, data: bytes) -> bytes:
    """AES in CBC mode, without padding."""
    box, (t0, t1, t2, t3) = _tables()
    w, out = _schedule(key), bytearray()
    a, b, c, d = (int.from_bytes(iv[i : i + 4], "big") for i in (0, 4, 8, 12))
    for at in range(0, len(data), 16):
        p = int.from_bytes(data[at : at + 16], "big")
        a, b, c, d = a ^ p >> 96 ^ w[0], b ^ p >> 64 & 0xFFFFFFFF ^ w[1], c ^ p >> 32 & 0xFFFFFFFF ^ w[2], d ^ p & 0xFFFFFFFF ^ w[3]
        for k in range(4, len(w) - 4, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ w[k],
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ w[k + 1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ w[k + 2],
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ w[k + 3],
            )
        last = lambda p, q, r, s, k: (box[p >> 24] << 24 | box[q >> 16 & 255] << 16 | box[r >> 8 & 255] << 8 | box[s & 255]) ^ k
        a, b, c, d = last(a, b, c, d, w[-4]), last(b, c, d, a, w[-3]), last(c, d, a, b, w[-2]), last(d, a, b, c, w[-1])
        out += b"".join(x.to_bytes(4, "big") for x in (a, b, c, d))
    return bytes(out)


def _hash(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    """The hardened hash of revision 6: at least 64 rounds of AES and one of three SHA-2s, until the last byte allows an end."""
    k, n = hashlib.sha256(password + salt + user).digest(), 0
    while True:
        e = cbc(k[:16], k[16:32], (password + k + user) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


class Lock:
    """Encrypts a PDF's strings and streams under a password that both opens it and owns it."""

    def __init__(self, password: str, random=os.urandom, permissions: int = -4):
        word = password.encode()[:127]
        self.random, self.key = random, random(32)
        salts = [random(8) for _ in range(4)]
        user = _hash(word, salts[0]) + salts[0] + salts[1]
        owner = _hash(word, salts[2], user) + salts[2] + salts[3]
        wrapped = [cbc(_hash(word, salts[1]), bytes(16), self.key), cbc(_hash(word, salts[3], user), bytes(16), self.key)]
        rights = permissions.to_bytes(4, "little", signed=True) + b"\xff\xff\xff\xffTadb" + random(4)
        hexed = lambda b: f"<{b.hex().upper()}>"
        self.dictionary = (
            f"<< /Filter /Standard /V 5 /R 6 /Length 256 /P {permissions} /U {hexed(user)} /UE {hexed(wrapped[0])} /O {hexed(owner)} /OE {hexed(wrapped[1])} "
            f"/Perms {hexed(cbc(self.key, bytes(16), rights))} /CF << /StdCF << /CFM /AESV3 /AuthEvent /DocOpen /Length 32 >> >> /StmF /StdCF /StrF /StdCF >>"
        )

    def __call__(self, data: bytes) -> bytes:
        pad, iv = 16 - len(data) % 16, self.random(16)
        return iv + cbc(self.key, iv, data + bytes([pad]) * pad)


def seal(data: Column, lock: Lock) -> Column:
    """What lock(data) does, by Spark's own AES: a random vector, then the data with padding. For all that is large; the class above is for a file's few strings."""
    return F.aes_encrypt(data, F.lit(bytearray(lock.key)), F.lit("CBC"))
