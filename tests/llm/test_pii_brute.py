"""The whole replacement once more in plain Python, text by text, with collisions."""

import random
from hashlib import sha256

import regex

from confuscope.llm import pii

KEY = pii.Key("brute")
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
# Java's names of properties, in this library's spelling.
ENTITY = regex.compile(pii.ENTITY)
SECRET_HEAD = r"((?i:password|passwd|pwd|token|secret|api_?key)\s*[=:]\s*[\"']?)"


def stream(kind, value, attempt):
    return "".join(sha256("\x1f".join((KEY.secret, kind, value, str(attempt), str(b))).encode()).hexdigest() for b in range(3))


def byte(s, i):
    i %= 96
    return int(s[2 * i : 2 * i + 2], 16)


def reshape(value, s, keep=0, hexed=False):
    out = []
    for i, c in enumerate(value):
        n = byte(s, i)
        if i < keep:
            out.append(c)
        elif c in DIGITS:
            out.append((HEX if hexed else DIGITS)[n % (16 if hexed else 10)])
        elif c in LOWER:
            out.append(HEX[n % 16] if hexed and c in "abcdef" else LOWER[n % 26])
        elif c in UPPER:
            out.append(UPPER[n % 26])
        else:
            out.append(c)
    return "".join(out)


def grown(value, s, attempt, alphabet, **how):
    return reshape(value, s, **how) + "".join(alphabet[byte(s, 95 - k) % len(alphabet)] for k in range(1, attempt - 2))


def luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10


def kind_of(v):
    return next(k for k, p in pii.PATTERNS if regex.fullmatch(p, v))


def is_real(v):
    return kind_of(v) != "CARD" or v[0] in "23456" and luhn(v) == 0


def bare(v):
    return regex.sub(r"[ ()+./-]", "", v)


def trunk(v):
    return regex.match(r"(\+(?:1|44)|0+|)", regex.sub(r"[ ().-]", "", v))[1].lstrip("+")


def names(v):
    return v.split(" ")[1:]


def initials(n):
    return n[-1] == "."


def head(kind, v):
    return v[:4] if kind == "AWS_KEY" else regex.match(SECRET_HEAD, v)[1]


def atoms(v):
    kind = kind_of(v)
    if kind == "EMAIL":
        return [("DOMAIN", v.lower().split("@")[1]), ("MAILBOX", v.lower())]
    if kind in ("SECRET", "AWS_KEY"):
        return [(kind, v[len(head(kind, v)) :])]
    if kind == "PHONE":
        return [(kind, bare(v)[len(trunk(v)) :])]
    if kind == "PERSON":
        return [("NAME", n.lower()) for n in names(v) if not initials(n)]
    return [(kind, v if kind == "IP" else bare(v))]


def stem(name, a):
    s, cyrillic = stream("NAME", name, a), "а" <= name[0] <= "я"
    starts, middles = (pii.CYRILLIC_STARTS, pii.CYRILLIC_MIDDLES) if cyrillic else (pii.LATIN_STARTS, pii.LATIN_MIDDLES)
    return starts[byte(s, 0) % 16] + "".join(middles[byte(s, k) % 16] for k in range(1, a + 3))


def ends(name, given, female):
    if "а" <= name[0] <= "я":
        return pii.CYRILLIC_ENDS_FEMALE if female else pii.CYRILLIC_ENDS_MALE
    return (pii.LATIN_ENDS_FEMALE if female else pii.LATIN_ENDS_MALE) if given else pii.LATIN_ENDS_FAMILY


def made(kind, v, a, shown=None):
    """The surrogate of an atom; shown: the part that is written, with its cases."""
    s = stream(kind, v, a)
    if kind == "MAILBOX":
        return grown(shown if shown is not None else v.split("@")[0], s, a, LOWER)
    if kind == "DOMAIN":
        host, _, tld = (shown or v).rpartition(".")
        return grown(host, s, a, LOWER) + "." + tld
    if kind in ("SECRET", "AWS_KEY"):
        if regex.fullmatch("[0-9a-f]+", v):
            return grown(v, s, a, HEX, hexed=True)
        return grown(v.lower(), s, a, HEX, hexed=True).upper() if regex.fullmatch("[0-9A-F]+", v) else grown(v, s, a, LOWER)
    if kind == "IP":
        tail = f"{byte(s, 2)}.{byte(s, 3) % 254 + 1}"
        if v.startswith("192.168.") and a <= 3:
            return f"192.168.{tail}"
        if regex.match(r"10\.|127\.|192\.168\.", v) and a <= 6:
            return f"{'10' if v.startswith('192') else v.split('.')[0]}.{byte(s, 1)}.{tail}"
        return f"{byte(s, 0) % 112 + 11}.{byte(s, 1)}.{tail}"
    if kind == "CARD":
        front = grown(v, s, a, DIGITS, keep=1)[:-1]
        return front + str((10 - luhn(front + "0")) % 10)
    return grown(v, s, a, DIGITS)


def claims(kind, v, a):
    if kind == "NAME":
        every = {e for given in (0, 1) for female in (0, 1) for e in ends(v, given, female)}
        return {("NAME", (stem(v, a) + e).lower()) for e in every}
    return {(kind, made(kind, v, a) + ("@" + v.split("@")[1] if kind == "MAILBOX" else ""))}


def attempts(real):
    now, settled, done = dict.fromkeys(real, 0), set(), {}
    while now:
        claimed = {x: claims(*x, a) for x, a in now.items()}
        owner = {}
        for x in sorted(claimed, key="\x1f".join):
            for c in claimed[x]:
                owner.setdefault(c, x)
        bad = {x for x, cs in claimed.items() if any(owner[c] != x or c in settled or (c in real and (c[0] != "MAILBOX" or c == x)) for c in cs)}
        for x in set(now) - bad:
            settled |= claimed[x]
            done[x] = now[x]
        now = {x: now[x] + 1 for x in bad}
    return done


def lay(v, new):
    new = list(new)
    return "".join(c if c in " ()+./-" else new.pop(0) for c in v) + "".join(new)


def surrogate(v, at):
    kind, found = kind_of(v), atoms(v)
    if kind == "EMAIL":
        local, domain = v.split("@")
        return made("MAILBOX", v.lower(), at[found[1]], local) + "@" + made("DOMAIN", domain.lower(), at[found[0]], domain)
    if kind == "PERSON":
        title, *rest = v.split(" ")
        female = title in ("Mrs.", "Г-жа") or title == "Dr" and rest[0][-1] in "aeая"
        out = [title]
        for k, n in enumerate(rest):
            if initials(n):
                turn = KEY.rotation(UPPER)
                out.append("".join(turn[UPPER.index(c)] if c in UPPER else c for c in n))
                continue
            a = at["NAME", n.lower()]
            e = ends(n.lower(), k < len(rest) - 1, female)
            out.append(stem(n.lower(), a) + e[byte(stream("NAME", n.lower(), a), 95) % len(e)])
        return " ".join(out)
    one = found[0]
    if kind in ("SECRET", "AWS_KEY"):
        return head(kind, v) + made(*one, at[one])
    if kind == "IP":
        return made(*one, at[one])
    return lay(v, (trunk(v) if kind == "PHONE" else "") + made(*one, at[one]))


def texts():
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice(DIGITS) for _ in range(n))
    word = lambda: "".join(rng.choice(LOWER) for _ in range(rng.randrange(2, 9)))
    name = lambda: rng.choice(["Smith", "Brown", "O'Brien", "Lee", "Lopez", word().title()])
    make = [
        lambda: f"{word()}.{digits(2)}@mail{digits(1)}.example.com", lambda: f"{rng.choice(LOWER)}@mail.example.com", lambda: f"{word().title()}_x@{word()}.co.uk", lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
        lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: "4" + digits(15), lambda: "5555 5555 5555 4444", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: f"020 7946 0{digits(3)}",
        lambda: f"10.{rng.randrange(256)}.0.9", lambda: f"192.168.{rng.randrange(3)}.{rng.randrange(200)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f'token = "{sha256(digits(5).encode()).hexdigest()[:20]}"',
        lambda: f"password={word()}{digits(3)}ABCDEFG", lambda: "AKIA" + "".join(rng.choice(UPPER + DIGITS) for _ in range(16)), lambda: "v" + digits(2), lambda: digits(4), lambda: "ñandú", lambda: "1.2.3",
        lambda: f"Mr. {name()}", lambda: f"Mrs. Anna {name()}", lambda: f"Dr {rng.choice(['Maria', 'John'])} {name()}", lambda: f"Mr. J. {name()}", lambda: f"Г-жа Анна {rng.choice(['Петрова', 'Иванова'])}",
    ]
    return [" , ".join(rng.choice([word, *make])() + rng.choice(["", ",", ";", "\n"]) for _ in range(rng.randrange(1, 25))) for _ in range(400)]


def test_same_as_brute_force(spark):
    rows = list(enumerate(texts()))
    found = {k: [m for m in ENTITY.findall(t) if is_real(m)] for k, t in rows}
    at = attempts({x for ms in found.values() for m in ms for x in atoms(m)})
    got = {r["doc_id"]: (r["text"], r["n"]) for r in pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string"), KEY, count_as="n").collect()}
    for k, t in rows:
        assert got[k] == (ENTITY.sub(lambda m: surrogate(m[0], at) if is_real(m[0]) else m[0], t), len(found[k]))
    kinds = [kind_of(m) for ms in found.values() for m in ms]
    assert len(kinds) > 2000 and kinds.count("PERSON") > 200 and max(at.values()) > 2
