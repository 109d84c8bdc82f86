import datetime
import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from duecall.llm import pii


def out(spark, texts, key=pii.KEY):
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, found int")
    return {r.doc_id: r for r in pii.pseudonymised(df, key).collect()}


def luhn(digits):
    total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def test_formats_validity_and_links(spark):
    texts = [
        "card 4111 1111 1111 1111 and 4111111111111111, bad 4111111111111112 end",
        "GB82WEST12345698765432 and DE89 3704 0044 0532 0130 00.",
        "2021-03-04 04/03/2021 2021-02-30 05.06.1999 12/31/2020",
        "+1 (743) 555-3824 743-555-3824 +49 30 1234567",
        "123-45-6789 666-12-1234 000-11-2222",
        "192.168.1.77 300.1.1.1",
        'A.b@x.example.com token = "11acdfb36bb72224148e6160f674b4be45601bff"',
        None,
        "",
        "nothing here, only 12 words in 1999",
    ]
    got = out(spark, texts)
    a, b, bad = re.findall(r"\d[\d ]{14,}\d", got[0].text)
    assert a.replace(" ", "") == b and luhn(b) and b != "4111111111111111" and bad == "4111111111111112"
    assert re.fullmatch(r"GB\d\dWEST\d{14} and DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d\.", got[1].text)
    x = got[1].text.split(" ")[0]
    assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    iso, slash, invalid, *_ = got[2].text.split(" ")
    assert iso.split("-") == slash.split("/")[::-1] and invalid == "2021-02-30" and iso != "2021-03-04"
    p = got[3].text
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} \d{3}-\d{3}-\d{4} \+49 \d\d \d{7}", p)
    assert re.sub(r"\D", "", p.split(" +")[0])[1:11] == re.sub(r"\D", "", p.split(" ")[3])
    assert got[4].text.endswith(" 666-12-1234 000-11-2222") and not got[4].text.startswith("123-45-6789")
    assert got[5].text.endswith(" 300.1.1.1") and all(0 <= int(v) < 256 for v in got[5].text.split(" ")[0].split("."))
    assert "x.example.com" not in got[6].text and "11acdf" not in got[6].text and re.search(r'token = "[0-9a-f]{40}"', got[6].text)
    assert got[7].text is None and got[8].text == "" and got[9].text == texts[9]
    assert got[0].found == ["card", "card"] and got[9].found == []
    assert out(spark, texts[:1], "other key")[0].text != got[0].text


def test_secrets_are_replaced_to_their_end(spark):
    long, jwt, padded = "a1B2" * 75, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U", "QUJDREVGR0hJSktMTU5PUA=="
    texts = [f'token = "{long}" end', f"secret: {jwt}. Next", f"api_key={padded}", f"api_key={jwt[:9]}.{long}", "password: short.one", "token=" * 50_000, "secret: " + "a." * 100_000]
    got = out(spark, texts)
    assert re.fullmatch(r'token = "[0-9a-f]{300}" end', got[0].text)
    assert re.fullmatch(rf"secret: [0-9a-f]{{{len(jwt)}}}\. Next", got[1].text)
    assert re.fullmatch(r"api_key=[0-9a-f]{24}", got[2].text) and re.fullmatch(r"api_key=[0-9a-f]{310}", got[3].text)
    assert got[4].text == texts[4] and all(got[k].found == ["secret"] for k in (0, 1, 2, 3, 5, 6))
    assert [len(got[k].text) for k in got] == [len(t) for t in texts]


def test_feistel_is_a_permutation(spark):
    df = spark.range(12 * 7).select((F.col("id") % 12).alias("a"), F.floor(F.col("id") / 12).alias("b"))
    pairs = df.select(pii.permuted("t", "k", F.col("a"), F.col("b"), F.lit(12), F.lit(7)).alias("p")).select("p.x", "p.y").collect()
    assert Counter(map(tuple, pairs)).most_common(1)[0][1] == 1
    assert {r.x for r in pairs} == set(range(12)) and {r.y for r in pairs} == set(range(7))


def test_repeated_rows_very_long_texts_and_empty_table(spark):
    long = "x" * 300_000 + " 4111111111111111 " + "a." * 50_000
    got = out(spark, [long, long])
    assert got[0].text == got[1].text and len(got[0].text) == len(long) and got[0].found == ["card"]
    assert pii.pseudonymised(spark.createDataFrame([], "doc_id long, text string"), pii.KEY).count() == 0


# The same in plain Python, value by value.


def network(kind, key, x, y, rows, columns):
    for i in range(8):
        own = columns if i % 2 else rows
        h = int(hashlib.sha256(f"{key}|{kind}|{i}|{y}".encode()).hexdigest()[:14], 16)
        x, y = y, (x + h) % own
    return x, y


def shape(form, new):
    left = iter(new)
    return "".join(next(left) if c in "0123456789" else c for c in form)


def scramble(kind, key, s):
    a = len(s) // 2
    x, y = network(kind, key, int(s[:a] or 0), int(s[a:]), 10**a, 10 ** (len(s) - a))
    return (f"{x:0{a}}" if a else "") + f"{y:0{len(s) - a}}"


def twin(kind, key, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        check = lambda b: next(c for c in "0123456789" if luhn(b + c))
        new = scramble(kind, key, d[:-1])
        return shape(m, new + check(new)) if luhn(d) else None
    if kind == "iban":
        c = m.replace(" ", "")
        worth = lambda t: int("".join(str(int(x, 36)) for x in t))
        inner = shape(c[4:], scramble(kind, key, re.sub("[^0-9]", "", c[4:])))
        check = 98 - worth(inner + c[:2] + "00") % 97
        return shape(m, f"{check:02}" + re.sub("[^0-9]", "", inner)) if worth(c[4:] + c[:4]) % 97 == 1 else None
    if kind == "phone":
        if re.fullmatch(r"(\+?1[ .-]?)?(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+1\d{10}", m):
            area, exchange, line = int(d[-10:-7]), int(d[-7:-4]), int(d[-4:])
            if area < 200 or exchange < 200:
                return None
            x, y = network(kind, key, area - 200, (exchange - 200) * 10_000 + line, 800, 8_000_000)
            return shape(m, d[:-10] + f"{x + 200:03}{y // 10_000 + 200:03}{y % 10_000:04}")
        code = re.match(r"\+([17]|\d\d)" if re.fullmatch(r"\+\d{8,15}", m) else r"\+(\d{1,3})", m)[1]
        return shape(m, code + scramble(kind, key, d[len(code) :])) if 8 <= len(d) <= 15 else None
    if kind == "ssn":
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        x, y = network(kind, key, area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        return shape(m, f"{x + 1 + (x >= 665):03}{y // 9999 + 1:02}{y % 9999 + 1:04}")
    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        x, y = network(kind, key, o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return ".".join(map(str, (x // 256, x % 256, y // 256, y % 256))) if max(o) < 256 else None
    if kind == "date":
        for looks, form in ((r"\d{4}-", "%Y-%m-%d"), (r"\d{4}/", "%Y/%m/%d"), (r"\d\d/", "%d/%m/%Y"), (r"\d\d/", "%m/%d/%Y"), (r"\d\d\.", "%d.%m.%Y")):
            if re.match(looks, m):
                try:
                    n = (datetime.datetime.strptime(m, form).date() - datetime.date(1900, 1, 1)).days
                except ValueError:
                    continue
                if 0 <= n < 17 * 4297:
                    x, y = network(kind, key, n // 4297, n % 4297, 17, 4297)
                    return (datetime.date(1900, 1, 1) + datetime.timedelta(x * 4297 + y)).strftime(form)
        return None
    if kind == "email":
        return "user-" + hashlib.sha256(f"{key}|email|{m.lower()}".encode()).hexdigest()[:32] + "@example.invalid"
    name, value, quote = re.fullmatch(r"(\w+\W?\w*\s{0,3}[=:]\s{0,3}\"?)([^\"]*)(\"?)", m).groups()
    h = hashlib.sha256(f"{key}|secret|{value}".encode()).hexdigest()
    return name + (h * (len(value) // 64 + 1))[: len(value)] + quote


def test_whole_texts_as_brute_force(spark):
    import regex

    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def value():
        card = digits(15)
        card += next(c for c in "0123456789" if luhn(card + c))
        number = digits(14)
        check = 98 - int("".join(str(int(c, 36)) for c in "WEST" + number + "GB00")) % 97
        made = [
            card, digits(16), "-".join(card[k : k + 4] for k in (0, 4, 8, 12)), f"GB{check:02}WEST{number}", f"GB11WEST{number}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", "+1" + digits(10), "+49" + digits(9),
            f"+44 20 {digits(4)} {digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}", ".".join(str(rng.randint(0, 300)) for _ in range(4)), f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{rng.randint(1, 31):02}/{rng.randint(1, 12):02}/1999",
            f"a.{digits(3)}@mail.example.org", "token = " + digits(30), f'api_key: "{digits(20)}.{digits(90)}"', digits(9),
        ]
        return rng.choice(made)

    texts = [" ".join(rng.choice(["word", "in", value(), value()]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    got, kinds = out(spark, texts), Counter()
    for k, text in enumerate(texts):
        found = []

        def new(m, found=found):
            for kind, p in pii.PATTERNS.items():
                if regex.fullmatch(p, m[0]):
                    if (value := twin(kind, pii.KEY, m[0])) is not None:
                        found.append(kind)
                    return m[0] if value is None else value
            raise AssertionError(m[0])

        assert got[k].text == regex.sub(pii.PATTERN, new, text), text
        assert got[k].found == found
        kinds.update(found)
    assert set(kinds) == set(pii.KINDS) and min(kinds.values()) > 10
