import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

pytest.importorskip("ahocorasick")
from leadloom.llm import canonical, linkage, survivors  # noqa: E402

REFERENCE = [
    (1, "title", "Backend Engineer", None), (2, "title", "Senior Backend Engineer", None), (3, "title", "Site Reliability Engineer", ["SRE"]), (4, "title", "Senior Site Reliability Engineer", None),
    (5, "title", "Head of Finance", None), (6, "title", "Machine Learning Engineer", None), (7, "title", "Data Analyst", None), (8, "title", "Director of Engineering", None), (9, "title", "Co-Founder", None),
    (20, "department", "Engineering", ["Entwicklung"]), (21, "department", "Risk & Compliance", None), (22, "department", "Finance", ["Finanzen"]), (23, "department", "Technical Support", None), (24, "department", "User Research", None),
]
TITLES = {
    "Backend Engineer": 1, "  ENGINEER, backend (m/w/d)": 1, "Sr. Backend Engr | Berlin": 2, "Backend Engineer (Senior) (f/m/x)": 2, "Ｂａｃｋｅｎｄ Ｅｎｇｉｎｅｅｒ": 1, "backendengineer": 1, "Back-End Eng": 1, "Bakcend Engineer": 1,
    "sre": 3, "SRE - Snr": 4, "Hiring: SRE (Ref. 20-118)": 3, "Head of Finanzen": 5, "ML Engineer @ Acme": 6, "Analista de datos": 7, "Dir. of Entwicklung": 8, "CoFounder": 9, "1. Data\xa0Anlyst #4411": 7,
    "Head of Kitchen": 0, "Marine Engineer": 0, "n/a": 0, "12345": 0, "": 0, "   ": 0, "x": 0, "Data Entry Typist": 0, "Engineer " * 3000: 0,
}
DEPARTMENTS = {"Risk &amp; Compliance": 21, "and Compliance - Risk": 21, "helpdesk": 23, "Research (User)": 24, "researchuser": 24, "Finnace": 22, "Canteen": 0}


@pytest.mark.parametrize(("kind", "values"), [("title", TITLES), ("department", DEPARTMENTS)])
def test_values(kind, values):
    canon = canonical.Canon([(i, label, aliases) for i, k, label, aliases in REFERENCE if k == kind], kind, canonical.translations(REFERENCE))
    assert {v: canon.find(v) for v in values} == values


def test_one_slip_is_one_edit():
    def near(a, b):
        return any(b in {a[:i] + a[i + 1 :], a[:i] + c + a[i:], a[:i] + c + a[i + 1 :], a[:i] + a[i + 1 : i + 2] + a[i : i + 1] + a[i + 2 :]} for i in range(len(a) + 1) for c in "abc")

    rng = random.Random(6)
    for _ in range(4000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(2))
        if a != b:
            assert canonical.one_slip(a, b) == near(a, b), (a, b)


def test_canonical_query(spark):
    job, lead = "struct<title:string,department:string,extra:int>", "struct<title_raw:string>"
    cases = spark.createDataFrame([(1, ("SRE", None, 1), ("Data Analyst",), 5), (1, ("SRE", None, 1), None, 5), (2, None, (None,), 5)], f"case_id long, job {job}, lead {lead}, ref_id int")
    reference = spark.createDataFrame([(*r[:3], r[3]) for r in REFERENCE], "ref_id long, kind string, label string, aliases array<string>")
    got = sorted(tuple(r) for r in canonical.canonical_values(cases, reference).collect())
    assert got == [(1, "job.title", 3), (1, "job.title", 3), (1, "lead.title_raw", 7)]
    assert canonical.canonical_values(cases.limit(0), reference).count() == 0
    assert {r.ref_id for r in canonical.canonical_values(cases, reference.limit(0)).collect()} == {0}


@pytest.mark.parametrize(
    ("fn", "values"),
    [
        (survivors.email_value, {" <A.B@C.example> ": "a.b@c.example", "mailto:x@y.example": "x@y.example", "m***@c.example": None, "info@c.example": None, "name(at)mail": None, "a@@b.example": None, "none@none.invalid": None, None: None, "": None}),
        (survivors.phone_value, {"+1 (415) 555-0168": "14155550168", "(415) 555-0168": "14155550168", "001 415 555 0168": "14155550168", "tel:+493023125229": "493023125229", "+49 (0) 30 23125229": "493023125229", "+1415*****62": None, "1234": None, "0000000000": None, "ext. 12": None, None: None}),
        (survivors.linkedin_value, {"https://de.l.example/in/Ann-Lee-1a/?x=1": "ann-lee-1a", "l.example/in/": None, "https://l.example/company/x": None, None: None}),
        (survivors.title_value, {"  Head  of  X ": "head of x", "Head of…": None, "n/a": None, "...": None, "": None, None: None}),
    ],
)
def test_usable_values(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r[0]: r[1] for r in df.select("v", fn(df.v).alias("out")).collect()} == values


LEADS = "ingest_seq long, lead_id string, source string, full_name string, title_raw string, linkedin_url string, email string, email_status string, phone string, confidence double, retrieved_at timestamp, enrichment_status string, field string, value string"


def lead_rows(spark, n=400):
    """Leads whose true values change once, with weak rows of other people between."""
    rng, rows, want, seq = random.Random(8), [], {}, 0
    for i in range(n):
        lead, t = f"l{i:04}", datetime(2025, 1, 1)
        switch, count = rng.randint(1, 4), rng.randint(2, 5)
        last = {}
        for k in range(count):
            seq, t = seq + 1, t + timedelta(days=rng.randint(1, 90))
            phone, title = ("+12125550" + f"{i:03}", "Clerk") if k < switch else ("+13035550" + f"{i:03}", "Manager")
            row = dict(phone=phone, title_raw=title, email=f"p{i}@c.example", linkedin_url=f"x.example/in/p{i}")
            rows.append((seq, lead, rng.choice(["pdl", "apollo"]), "P Q", title, row["linkedin_url"], row["email"], "verified", phone, 0.8, t, "enriched", "f", "v"))
            for field, column in (("phone", "phone"), ("title", "title_raw"), ("email", "email"), ("linkedin_url", "linkedin_url")):
                last[lead, field] = seq
            if rng.random() < 0.5:
                seq, t = seq + 1, t + timedelta(days=1)
                rows.append((seq, lead, "pdl", "O P", f"Other {rng.random()}", f"x.example/in/other{seq}", f"o{seq}@c.example", "guessed", f"+1512{seq:07}", rng.choice([0.8, 0.1]), t, "enrichment_identity_weak", "f", "v"))
        want |= last
    return spark.createDataFrame(rows, LEADS), want


def test_survivors_are_the_last_true_values(spark):
    records, want = lead_rows(spark)
    got = {(r.lead_id, r.field): r.ingest_seq for r in survivors.surviving_values(records).collect()}
    right = sum(got.get(k) == v for k, v in want.items())
    assert right >= 0.99 * len(want) and len(got) <= 1.01 * len(want)
    quality = survivors.source_quality(survivors.facts(survivors.claims(records)))
    own = [s + p for k, (s, p) in quality.items() if "|own|" in k]
    weak = [s + p for k, (s, p) in quality.items() if "|weak|" in k]
    assert min(own) > 1 > max(weak)


def test_survivors_of_odd_rows(spark):
    t = datetime(2026, 1, 1)
    rows = [
        (1, "once", "pdl", "A B", "T one", None, None, None, None, 0.9, t, "enriched", "f", "v"),
        (2, "twice", "pdl", None, "T two", None, None, None, None, 0.9, t, "enriched", "f", "v"),
        (2, "twice", "pdl", None, "T two", None, None, None, None, 0.9, t, "enriched", "f", "v"),
        (3, "blank", "pdl", "A", "n/a", None, None, None, None, None, None, None, "f", "v"),
        (4, "blank", None, None, None, None, None, None, None, None, t, None, "f", "v"),
        (5, None, "pdl", "A", "T", None, None, None, None, 0.9, t, "enriched", "f", "v"),
    ]
    got = survivors.surviving_values(spark.createDataFrame(rows, LEADS)).collect()
    assert [(r.lead_id, r.field, r.ingest_seq) for r in got] == [("twice", "title", 2)]
    assert survivors.surviving_values(spark.createDataFrame([], LEADS)).count() == 0


def test_names_and_companies():
    assert linkage.split_name("CASIDDEN, Rebecca", None, None) == ("rebecca", "casidden")
    assert linkage.split_name("Dr. Becca X. Łazarro, PhD 🚀", None, None) == ("rebecca", "lazarro")
    assert linkage.split_name(None, "Ann", "J. Müller-Roy") == linkage.split_name("Ann Mueller-Roy", None, None) == ("ann", "muller-roy")
    assert linkage.split_name("A. Lee", None, None) == ("a", "lee")
    assert {linkage.domain_core(x) for x in ("https://www.getacmecloud.example/careers?x=1", "ACMECLOUD.EXAMPLE.", "careers.acme-cloud.co.example", "acmecloud-hq.test", "acmecloudapp.example")} == {"acmecloud"}
    assert linkage.company_words("Acme Cloud Holding B.V.") == ["acme", "cloud"]
    assert linkage.title_words("Sr. Eng, Backend") == linkage.title_words("Senior Backend Engineer")


COMPANY, LEAD = "struct<name:string,domain:string>", "struct<name:string,title:string>"
PERSON = "person_id string, provider string, name string, first_name string, last_name string, last_name_obfuscated string, title string, org_name string, org_website string, gtm_id string"


def test_matches_and_their_repetitions(spark):
    rng = random.Random(2)
    syllables = ["bel", "cor", "dun", "eld", "fen", "gar", "hol", "ing", "jor", "kel", "lor", "mar"]
    leads, persons, want = [], [], set()
    for i in range(300):
        first = rng.choice(["Rebecca", "Anton", "Mira", "Omar", "Signe"])
        last = "".join(rng.sample(syllables, 3)).capitalize()
        hot = i % 3 == 0
        company = "Hotline Studio" if hot else f"{''.join(rng.sample(syllables, 2)).capitalize()} Works"
        domain = company.lower().replace(" ", "") + ".example"
        title = rng.choice(["Head of Data", "Clerk", "Sales Engineer", "General Counsel"])
        leads += [(f"g{i:03}{k}", (company, domain), (f"{first} {last}", title), "x") for k in range(2 if i % 10 == 0 else 1)]
        typo = last[:3] + last[4] + last[3] + last[5:]
        forms = [(f"{last.upper()}, {first}", None, None, None), (None, first, None, last[:2] + "*" * (len(last) - 3) + last[-1]), (f"{first} {typo}", None, None, None), (f"{first[0]}. {last}", None, None, None)]
        name, f, l, hidden = forms[i % 4]
        persons.append((f"p{i:03}", "pdl", name, f, l, hidden, title, company + " Ltd", f"https://www.{domain}/", "clash"))
        want |= {(f"g{i:03}{k}", f"p{i:03}") for k in range(2 if i % 10 == 0 else 1)}
        persons.append((f"q{i:03}", "pdl", f"{first} {last}", None, None, None, title, "Elsewhere Bank", "elsewherebank.example", "clash"))
    persons += [("r1", "pdl", None, None, None, None, None, None, None, None), ("r2", "pdl", "🚀", None, None, None, "Clerk", None, None, None)]
    leads.append(("z", (None, None), (None, None), None))
    g = spark.createDataFrame(leads, f"gtm_id string, company {COMPANY}, lead {LEAD}, person string")
    p = spark.createDataFrame(persons, PERSON)
    got = linkage.matched_people(g, p).collect()
    found = {(r.gtm_id, r.person_id) for r in got}
    assert len(found) == len(got) and all(0 < r.confidence <= 1 for r in got)
    assert len(found & want) >= 0.97 * len(want) and len(found - want) <= 0.02 * len(want)
    assert linkage.matched_people(g.limit(0), p).count() == linkage.matched_people(g, p.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    """The k best leads of every record, among those whose whole score reaches the least one."""
    rng = random.Random(4)
    names = ["ann", "bea", "cem"]
    terms = lambda: sorted({f"F|{rng.choice(names)}", f"C|c{rng.randint(0, 3)}", f"T|t{rng.randint(0, 2)}", *(f"L|{rng.randint(0, 60)}" for _ in range(rng.randint(0, 3)))})
    sides = [{i: terms() for i in range(200)} for _ in range(2)]
    frames = [spark.createDataFrame([(i, [linkage.term_key(t) for t in ts]) for i, ts in s.items()], "class_id long, terms array<bigint>") for s in sides]
    pairs, top = linkage.candidates(*frames, k=2)
    got = {}
    for r in pairs.collect():
        got.setdefault(r.person, []).append((r.found, r.lead))
    import math

    df = {}
    for ts in sides[0].values():
        for t in ts:
            df[t] = df.get(t, 0) + 1
    weight = {t: math.log(1 + (200 - n + 0.5) / (n + 0.5)) * linkage.SHARES.get(t[0], 1.0) for t, n in df.items()}
    cut_off = 0
    for person, a in sides[1].items():
        scores = {lead: sum(weight[t] for t in set(a) & set(b)) for lead, b in sides[0].items()}
        reaching = sorted((v for v in scores.values() if v >= linkage.LEAST_SCORE * top), reverse=True)
        cut_off += len(reaching) > 2
        mine = sorted(got.get(person, []), reverse=True)
        assert [round(v, 9) for v, _ in mine] == [round(v, 9) for v in reaching[:2]]
        assert all(abs(scores[lead] - v) < 1e-9 for v, lead in mine)
    assert cut_off


def test_mixture_tells_matches_from_others(spark):
    """Two groups of patterns, no labels: the levels of the matches get weight, and rare disagreement of a match in one view is made up for by the others."""
    rng, rows = random.Random(6), []
    for i in range(2000):
        match = i % 2 == 0
        name, company = (1.0, 1.0) if match else rng.choice([(1.0, 0.0), (0.0, 1.0)])
        title = rng.choice([1.0] * 9 + [0.0]) if match else rng.choice([1.0] + [0.0] * 9)
        rows.append((name, name, company, title, rng.uniform(0.7, 1.0) if match else rng.uniform(-0.2, 0.2)))
    pairs = spark.createDataFrame(rows, "first double, last double, company double, title double, gap double")
    n, base, weights = linkage.agreement_weights(pairs)
    odds = base + sum(F.array(*[F.lit(w) for w in ws])[linkage.view(v)] for v, ws in weights.items())
    told = [r.odds > 0 for r in pairs.select(odds.alias("odds")).collect()]
    assert n == 2000 and sum(t == (i % 2 == 0) for i, t in enumerate(told)) >= 1990
    assert linkage.agreement_weights(pairs.limit(0))[0] == 0


def test_long_values_and_many_readings_meet_their_entry():
    long = "Alpha Bravo Charlie Delta Echo Foxtrot Golf Hotel India Juliett Kilo Lima Mike November Oscar"
    joined = "Communications Infrastructure Development Representative Administrator"
    begun = [f"Comb{x}{x} Sales{x}" for x in "abcdefghij"]
    canon = canonical.Canon([(n, label, None) for n, label in enumerate([long, joined, *begun], 1)], "title")
    assert canon.find(" ".join(reversed(long.split()))) == 1  # more than 12 words
    assert canon.find(joined.replace(" ", "").lower()) == 2  # more than 60 letters
    assert [canon.find(f"Sales{x} comb") for x in "abcdefghij"] == list(range(3, 13))  # 10 readings of a word
    assert canon.find("x" * 5000) == canon.find("of" * 5000) == 0


def test_readings_beyond_many_products():
    # 6 words of 8 readings: the fitting one is the last of 262,144
    words = [f"{stem}{x}{x}" for stem in ("abra", "bolo", "cinu", "dexo", "fumi", "gari") for x in "stuvwxyz"]
    entries = [(n, w, None) for n, w in enumerate(words, 1)] + [(99, " ".join(w for w in words if w.endswith("z")), None)]
    canon = canonical.Canon(entries, "title")
    assert canon.find("gari fumi dexo cinu bolo abra") == 99
