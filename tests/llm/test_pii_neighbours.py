"""op9 finds each kind whatever number stands before or after it."""

import time

import pytest

from voxloom.llm import pii

VALUES = {
    "email": ["a.b1@x.org"],
    "ip": ["192.168.1.20"],
    "card": ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"],
    "phone": ["555-123-4567", "(988) 555-2485-77", "+1 988-555-2485"],
    "date": ["2020-02-29", "31.12.2001"],
}


@pytest.mark.parametrize("number", ["7", "10", "123", "2024", "12345"])
def test_a_number_before_or_after(number):
    names = pii.Pseudonyms(b"k")
    for kind, values in VALUES.items():
        for v in values:
            alone = pii.replaced(v, names)
            assert alone[1] == [(kind, 0, len(v))], v
            at = len(number) + 1
            assert pii.replaced(f"{number} {v}", names) == (f"{number} {alone[0]}", [(kind, at, at + len(v))]), v
            assert pii.replaced(f"{v} {number}", names) == (f"{alone[0]} {number}", [(kind, 0, len(v))]), v


def test_spaced_phone_after_a_year_and_failed_cards():
    names = pii.Pseudonyms(b"k")
    assert pii.replaced("2024 555 123 4567", names)[0] == "2024 " + pii.replaced("555 123 4567", names)[0]
    for text in ("4111 1111 1111 1112", "20 4111 1111 1111 1112", "2020-02-30", "256.1.1.1"):
        assert pii.replaced(text, names) == (text, [])


def test_long_runs_take_linear_time():
    """Runs of letters, digits and marks without an address: no part of the search goes back over them."""
    names = pii.Pseudonyms(b"k")
    for run in ("x" * 2_000_000, "12" * 500_000, "a." * 500_000, "x@" * 500_000, "ab:" * 300_000, "AB12 " * 200_000 + "-"):
        began = time.process_time()
        assert pii.replaced(run, names) == (run, [])
        assert time.process_time() - began < 10
    assert pii.replaced("(a.b@x.org)", names)[1] == [("email", 1, 10)]
    long = "x" * 5000 + "7@y.org"  # a long name is masked as well
    new, spans = pii.replaced(long, names)
    assert spans == [("email", 0, 5007)] and len(new) == 5007 and new.endswith("@y.org") and sum(a == b for a, b in zip(new[:5000], long)) < 500


def spellings(rng):
    """(kind, value, its spellings) of made-up values."""
    import datetime

    for _ in range(300):
        d = datetime.date(1900, 1, 1) + datetime.timedelta(days=rng.randrange(73_000))
        if rng.random() < 0.2:
            d = d.replace(year=rng.choice([3, 1850, 1899, 2100, 9999]), day=min(d.day, 28))
        y, m, t = f"{d.year:04}", f"{d.month:02}", f"{d.day:02}"
        forms = [f"{y}-{m}-{t}", f"{y}/{m}/{t}", f"{y}.{m}.{t}", f"{t}/{m}/{y}", f"{t}.{m}.{y}", f"{t}-{m}-{y}"]
        yield "date", d, forms + ([f"{m}/{t}/{y}"] if d.day > 12 else [])
        n = f"{rng.randrange(2, 10)}{rng.randrange(100):02}{rng.randrange(2, 10)}{rng.randrange(10**6):06}"
        a, b, c = n[:3], n[3:6], n[6:]
        yield "phone", n, [f"+1 {a} {b} {c}", f"+1{n}", f"{a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", n, f"1-{a}-{b}-{c}", f"001 {a} {b} {c}", f"+1-{a}-{b}-{c}"]
        g = f"{rng.randrange(20, 99)}{rng.randrange(10**7):07}"
        yield "phone", g, [f"+49 {g[:2]} {g[2:]}", f"+49{g}", f"0{g[:2]} {g[2:]}"]
        k = [rng.randrange(1 << 16) if rng.random() < 0.7 else 0 for _ in range(8)]
        if sum(k) > 1:
            import ipaddress

            yield "ipv6", tuple(k), [":".join(f"{x:x}" for x in k), ":".join(f"{x:04x}" for x in k), str(ipaddress.IPv6Address(":".join(f"{x:x}" for x in k)))]
        account = "".join(rng.choice("0123456789") for _ in range(14))
        body = rng.choice(["WEST", "NWBK", "3704"]) + account
        check = 98 - int("".join(str(int(c, 36)) for c in body + "GB00")) % 97
        plain = f"GB{check:02}{body}"
        yield "iban", plain, [plain, " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))]
        area = rng.choice([1, 665, 667, 899, rng.randrange(1, 666)])
        s = f"{area:03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10000):04}"
        yield "ssn", s, [s]


def test_equal_values_in_all_spellings_stay_linked():
    """Equal values get equal pseudonyms however they are written, different values different ones, all of their kind."""
    import random

    names, back = pii.Pseudonyms(b"k"), {}
    plain = {
        "date": lambda x: tuple(sorted(x.replace("/", "-").replace(".", "-").split("-"))), "ipv6": lambda x: x, "ssn": lambda x: x,
        "phone": lambda x: pii.only_digits(x), "iban": lambda x: x.replace(" ", ""),
    }
    for kind, value, forms in spellings(random.Random(3)):
        made = {}
        for form in forms:
            new, spans = pii.replaced(f"see {form} there", names)
            assert spans == [(kind, 4, 4 + len(form))], (form, spans)
            new = new[4:-6]
            assert len(new) == len(form) or kind == "ipv6"
            key = plain[kind](new)
            if kind == "phone":
                key = key[-len(value) :]
            made[form] = key
        assert len(set(made.values())) == 1, made
        key = (kind, len(value) if kind == "phone" else 0, next(iter(made.values())))
        assert back.setdefault(key, value) == value
    assert sum(k[0] == "iban" for k in back) > 290


def test_permutations_of_days_and_numbers():
    """Every day of a range goes to another one of its class; numbers keep out of the others' way."""
    import datetime

    names = pii.Pseudonyms(b"k")
    first = datetime.date(1900, 1, 1)
    days = [first + datetime.timedelta(days=i) for i in range(73_049)]
    new = {names.date(d.isoformat()) for d in days[::7]}
    assert len(new) == len(days[::7]) and all("1900" <= x[:4] <= "2099" for x in new)
    assert all((int(names.date(d.isoformat())[8:]) > 12) == (d.day > 12) for d in days[::97])
    some = {f"1{i:010}": names.phone(f"1-{i:010}") for i in range(2 * 10**9, 2 * 10**9 + 200)} | {f"{i}": names.phone(f"{i}") for i in range(30000000000, 30000000200)}
    assert len({pii.only_digits(x) for x in some.values()}) == len(some)


def test_rows_of_every_kind(spark):
    """Repeated rows, null ids and texts, columns with names of the result."""
    rows = [(1, "on 2001-12-31", 9, "s"), (1, "on 2001-12-31", 9, "s"), (None, "at 31.12.2001", None, None), (2, None, 1, ""), (3, "", 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_date long, spans string")
    got = sorted((r.doc_id or 0, r.text or "", r.n_date, r.spans) for r in pii.pseudonymise(df, b"k").collect())
    first = pii.Pseudonyms(b"k").date("2001-12-31")
    y, m, d = first.split("-")
    assert got == [(0, f"at {d}.{m}.{y}", 1, "date:3:13"), (1, f"on {first}", 1, "date:3:13"), (1, f"on {first}", 1, "date:3:13"), (2, "", 0, ""), (3, "", 0, "")]
