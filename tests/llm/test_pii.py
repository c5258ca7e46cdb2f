import re

from spoor.llm import pii


def run(documents, rows, **kw):
    return {r.doc_id: r for r in pii.replaced(documents(rows), count="n_found", **kw).collect()}


def test_types_formats_and_coreference(documents):
    rows = [
        (1, "Mail the.72@mail3.example.com or THE.72@MAIL3.EXAMPLE.COM!! now."),
        (2, "call +1 (017) 555-7713 rethsh, card 4952935900253052 Heerha 4539-5787-6362-1486."),
        (3, 'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!! 9233a8ecf7c5b09fe5949719b6b82bc439e9329b at 161.17.88.162. Ssn 123-45-6789'),
        (4, "Mr. John Smith met Mrs Smith and Herr Müller; Mr John Smith left. г-жа Анна Петрова, κ. Γιώργος"),
        (5, "Nothing here: 3.0, 12 of 2024, v1.2.3, a@b, and 1.2.3.4.5"),
        (6, "the.72@mail3.example.com +1-017-555-7713"),
    ]
    got = run(documents, rows)
    t = {i: r.text for i, r in got.items()}
    a, b = re.findall(r"\S+@[A-Za-z\d.]+", t[1])
    assert a.lower() == b.lower() and b.isupper() and re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", a) and a != "the.72@mail3.example.com"
    assert t[6].startswith(a + " +1-")
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", t[2])
    assert phone and re.search(r"\+1-(\d{3})-(\d{3})-(\d{4})", t[6]).groups() == phone.groups() != ("017", "555", "7713")
    cards = re.findall(r"card (\d{16}) Heerha (\d{4}-\d{4}-\d{4}-\d{4})", t[2])[0]
    assert [luhn(c) for c in cards] == [luhn("4952935900253052"), luhn("4539578763621486")] and cards[0][0] == "4"
    up, low = re.findall(r"[0-9A-Fa-f]{40}", t[3])
    assert up.isupper() and up.lower() == low and up != "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    assert all(0 < int(x) < 256 for x in re.search(r"at ([\d.]+)\. ", t[3])[1].split(".")) and "161.17.88.162" not in t[3]
    names = re.findall(r"(?:Mr\.?|Mrs|Herr) ([A-Z]\w+(?: [A-Z]\w+)?)", t[4])
    assert names[0] == names[3] and names[0].split()[0] in pii.GIVEN["latin", "m"] and len(set(names)) == 3
    assert re.search(r"г-жа (\w+) (\w+)", t[4])[1] in pii.GIVEN["cyrillic", "f"] and re.search(r"κ\. (\w+)", t[4])[1] in " ".join(pii.FAMILY["greek"])
    assert t[5] == rows[4][1] and got[5].n_found == 0 and got[1].n_found == 2 and got[4].n_found == 6
    assert all("123-45-6789" not in x for x in t.values())
    for i, old in rows:  # all else stays
        gaps = re.split("|".join(map(re.escape, ["@"])), old)
        assert len(re.split("@", t[i])) == len(gaps)


def luhn(n):
    d = [int(x) for x in re.sub(r"\D", "", n)][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2]) & 0 == 0 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_distinct_even_in_a_small_domain(documents):
    people = [f"Mr {a}{b}" for a in ("Ab", "Cd", "Ef", "Gh", "Ij", "Kl") for b in ("ano", "eno", "ino", "ono", "uno", "yno", "abel")]
    got = run(documents, [(i, f"{p} came.") for i, p in enumerate(people)])
    new = [r.text.removesuffix(" came.").removeprefix("Mr ") for r in got.values()]
    assert len({n.lower() for n in new}) == len(people) and not {n.lower() for n in new} & {p[3:].lower() for p in people}


def test_key_changes_surrogates_and_repeats_hold(documents):
    rows = [(1, "x a.b@c.org y"), (1, "x a.b@c.org y")]
    one = [r.text for r in pii.replaced(documents(rows)).collect()]
    assert one[0] == one[1] != pii.replaced(documents(rows), key="other").first().text
    assert one == [r.text for r in pii.replaced(documents(rows)).collect()]


def test_odd_rows(documents, odd_rows):
    df = documents(odd_rows + [(None, "z@y.org"), (9, "w" * 200_000 + " q@r.org " + "1" * 100_000)])
    out = pii.replaced(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == len(odd_rows) + 2
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert [x for x in sorted([(r.doc_id, r.text) for r in rows], key=key) if "@" not in (x[1] or "")] == sorted(odd_rows, key=key)
    assert pii.replaced(documents([])).collect() == []
