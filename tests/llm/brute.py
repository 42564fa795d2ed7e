"""Plain versions of the operators, written from their definitions, for small inputs."""

import hashlib
import math
import re
import zlib

import xxhash

LOWER = str.maketrans({chr(a): chr(a + 32) for a in range(65, 91)})


def fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints):
    """Smallest id reachable over links of two or fewer bits, for each row."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = {}
    for i, p in zip(ids, prints):
        r = find(p)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(find(p)) for p in prints]


def fold(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def contamination(docs, items, size=10):
    """(n_words, n_hit, items_sha256, n_items) for each text; items are (id, text)."""
    windows = {}
    for item, text in items:
        words = fold(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for text in docs:
        words, hit, found = fold(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        out.append((len(words), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found)))
    return out


def quality_counts(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {g for g in grams if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
    covered = {k for i, g in enumerate(grams) if g in many for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
    }


def base_failed(c):
    return c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]


def em(votes, believed, prior=0.8, belief=0.25, rounds=400):
    """Expectation-maximisation over rows of votes (dicts), one row at a time; returns a function giving the log-odds."""
    names = list(votes[0])
    weights = {n: {v: math.log(g / b) for v, (g, b) in believed(n).items()} for n in names}
    start = math.log(prior / (1 - prior))

    def odds(row):
        return start + sum(weights[n][row[n]] for n in names)

    for _ in range(rounds):
        good = [1 / (1 + math.exp(-odds(r))) for r in votes]
        extra, n_good = belief * len(votes), sum(good)
        n_bad = len(votes) - n_good
        start = math.log((n_good + prior * extra) / (n_bad + (1 - prior) * extra))
        for n in names:
            for v, (g, b) in believed(n).items():
                on_good = sum(q for q, r in zip(good, votes) if r[n] == v)
                on_bad = sum(1 - q for q, r in zip(good, votes) if r[n] == v)
                weights[n][v] = math.log((on_good + g * extra) / (n_good + extra)) - math.log((on_bad + b * extra) / (n_bad + extra))
    return odds


def repeats(texts, length=400):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for x in data:
        for p in range(len(x) - length + 1):
            w = x[p : p + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for x in data:
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i in range(len(x)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def base_secrets(text):
    """(start, end, kind) of the three patterns."""
    text, found = text or "", []
    names = "|".join("".join(f"[{c}{c.upper()}]" for c in n) for n in ("password", "passwd", "secret", "token"))
    assign = rf"""(?:{names}|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, pattern, least, group in ((0, assign, 6, 1), (1, "AKIA[A-Z0-9]+", 20, 0), (2, "[0-9a-f]+", 24, 0)):
        found += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found, key=lambda f: (f[0], f[2]))


def token_rows(docs, tokenizer, end_id=2, as_given=False):
    """(doc_id, start, n_tokens, crc32) in order of id, or as given; docs are (id, text) with distinct ids."""
    start, out = 0, []
    for i, text in docs if as_given else sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


def pfair(counts, weights):
    """The source of every slot: of the released blocks the one with the earliest deadline, sources in the order given."""
    left, out = {s: n for s, n in counts.items() if n}, []
    while left:
        own = {s: weights[s] for s in left if weights[s]} or dict.fromkeys(left, 1)
        total, taken, slot = sum(own.values()), dict.fromkeys(own, 0), 0
        while all(taken[s] < left[s] for s in own):
            due = []
            for nth, (s, w) in enumerate(own.items()):
                if taken[s] * total // w <= slot:
                    due.append((-(-(taken[s] + 1) * total // w), nth, s))
            s = min(due)[2]
            taken[s] += 1
            out.append(s)
            slot += 1
        left = {s: n - taken.get(s, 0) for s, n in left.items() if n > taken.get(s, 0)}
    return out


def mixed(rows, block_chars, weights=None):
    """(slot, within, key, row) in the mixed order; rows are (key, doc_id, source, text)."""
    first = lambda x: (x is not None, x or 0)
    chars, placed = {}, []
    for row in sorted(rows, key=lambda r: (r[0], first(r[1]))):
        before = chars.get(row[2], 0)
        chars[row[2]] = before + max(1, len(row[3] or ""))
        placed.append((row, before))
    if weights is None:
        roots = {s: n**0.5 for s, n in chars.items()}
        weights = {s: max(1, round(10_000 * r / sum(roots.values()))) for s, r in roots.items()}
    names = sorted(chars, key=lambda s: (s is not None, s or ""))
    slots, seen = {}, {}
    for slot, s in enumerate(pfair({s: -(-chars[s] // block_chars) for s in names}, {s: weights[s] for s in names})):
        slots[s, seen.get(s, 0)] = slot
        seen[s] = seen.get(s, 0) + 1
    out = [(slots[row[2], before // block_chars], before % block_chars, row[0], row) for row, before in placed]
    return sorted(out, key=lambda o: (*o[:3], first(o[3][1])))


# Pseudonyms: value by value in whole numbers, by the patterns and formats of the operator.


def _prf(key, tag, turn, value):
    return int(hashlib.sha256(f"{key}|{tag}|{turn}|{value}".encode()).hexdigest()[:15], 16)


def feistel(left, right, left_size, right_size, key, tag, rounds=8):
    for i in range(rounds):
        if i % 2 == 0:
            left = (left + _prf(key, tag, i, right)) % left_size
        else:
            right = (right + _prf(key, tag, i, left)) % right_size
    return left, right


def _permuted(digits, key, tag):
    a = len(digits) // 2
    left, right = feistel(int(digits[:a]), int(digits[a:]), 10**a, 10 ** (len(digits) - a), key, tag)
    return f"{left:0{a}d}{right:0{len(digits) - a}d}"


def _redrawn(value, digits):
    draw = iter(digits)
    return "".join(next(draw) if "0" <= c <= "9" else c for c in value)


def _luhn(digits, doubled):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 == doubled else 1)
        total += x - 9 if x > 9 else x
    return total


def _mod97(text):
    return int("".join(c if c.isdigit() else str(ord(c) - 55) for c in text)) % 97


def _real(y, m, d):
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return y >= 1 and 1 <= m <= 12 and 1 <= d <= (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


def date_fields(value):
    """(form, month first, year, month text, day text), or None."""
    if "-" in value:
        y, m, d = value.split("-")
        found = ("-", True, int(y), m, d)
    elif "." in value:
        d, m, y = value.split(".")
        found = (".", False, int(y), m, d)
    else:
        a, b, y = value.split("/")
        first = _real(int(y), int(a), int(b))
        found = ("md" if first else "dm", first, int(y), a if first else b, b if first else a)
    return found if _real(found[2], int(found[3]), int(found[4])) else None


def date_pseudonym(value, key):
    form, first, year, month, day = date_fields(value)
    slash = form in ("md", "dm")
    late = slash and int(day) > 12
    least = 13 if late else 1
    most = 9 if len(day) == 1 else 12 if slash and not late else 31
    months, block = 9 if len(month) == 1 else 12, (year - 1900) // 150
    start = 1900 + 150 * block
    tag = f"date/{form}/{len(month)}/{len(day)}/{least}/{block}"
    left, right = (year - start) * months + int(month) - 1, int(day) - least
    while True:
        left, right = feistel(left, right, months * 150, most - least + 1, key, tag)
        y, m, d = start + left // months, left % months + 1, right + least
        if _real(y, m, d):
            break
    m, d, y = f"{m:0{len(month)}d}", f"{d:0{len(day)}d}", f"{y:04d}"
    return {"-": f"{y}-{m}-{d}", ".": f"{d}.{m}.{y}"}.get(form) or (f"{m}/{d}/{y}" if first else f"{d}/{m}/{y}")


def _email(value, key):
    local, domain = value.split("@")
    half = len(local) // 2
    sides = [list(local[:half]), list(local[half:])]
    for i in range(8):
        own, other = sides[i % 2], "".join(sides[1 - i % 2])
        for k, c in enumerate(own):
            by = _prf(key, "email", i * 1000 + k, other)
            for first, size in (("a", 26), ("A", 26), ("0", 10)):
                if 0 <= ord(c) - ord(first) < size:
                    own[k] = chr(ord(first) + (ord(c) - ord(first) + by % size) % size)
                    break
    return "".join(sides[0] + sides[1]) + "@" + domain


def pseudonym(value, key, is_iban, is_date, is_ssn, is_ip, is_card, is_phone):
    """(kind, replacement) of a match; the checks say which formats it has."""
    digits = re.sub("[^0-9]", "", value)
    plain = value.replace(" ", "")
    if "@" in value:
        return "email", _email(value, key)
    if is_iban(value) and _mod97(plain[4:] + plain[:4]) == 1:
        account = plain[4:]
        fresh = _redrawn(account, _permuted(re.sub("[^0-9]", "", account), key, "iban"))
        check = 98 - _mod97(fresh + plain[:2] + "00")
        return "iban", _redrawn(value, f"{check:02d}" + re.sub("[^0-9]", "", fresh))
    if is_date(value):
        return ("date", date_pseudonym(value, key)) if date_fields(value) else ("", value)
    if is_ssn(value):
        area, group, serial = value.split("-")
        if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
            return "", value
        left, right = feistel(int(area) - 1 - (int(area) > 666), (int(group) - 1) * 9999 + int(serial) - 1, 898, 99 * 9999, key, "ssn")
        return "ssn", f"{left + 1 + (left >= 665):03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"
    if is_ip(value):
        o = [int(x) for x in value.split(".")]
        if max(o) > 255:
            return "", value
        left, right = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        return "ip", f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if is_card(value) and 13 <= len(digits) <= 19:
        if _luhn(digits, 1) % 10:
            return "", value
        body = _permuted(digits[:-1], key, "card")
        return "card", _redrawn(value, body + str(-_luhn(body, 0) % 10))
    if is_phone(value) and 7 <= len(digits) <= 15:
        n = 10 if len(digits) in (10, 11) else min(len(digits), max(len(digits) - 2, 7))
        return "phone", _redrawn(value, digits[: len(digits) - n] + _permuted(digits[len(digits) - n :], key, "phone"))
    return "", value
