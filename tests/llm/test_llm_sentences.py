import random
import textwrap

import pytest

pytest.importorskip("ahocorasick")
from leadloom.llm.sentences import sentence_spans, sentence_units  # noqa: E402

CASES = [
    ["Dr. Ann Lee and Ms. Roe met.", "They left at 5 p.m. on Friday."],
    ["The U.S. team uses v1.2.3 of Foo.", "What a year…", "Send it to a@b.example!"],
    ["It costs $3,050.50, i.e. about 2.5 times more.", "Hours: Mon.–Thu., max. 8 h per week."],
    ["We work with Acme Corp.", "Honestly... it took 3 months.", "iScheda is our scheduler."],
    ["“We never ship on Friday!” says Ann.", "They said “maybe. or not” and left.", "The note is short: “Keep it. Move on.”", "Next one."],
    ["Who asked: “Why?”", "(More in the handbook.)", "Costs (see Fig. 4 and Sec. 7.4) rise."],
    ["Really?!", "Apply now!!! 🎉", "Ship it 🚀 — then breathe."],
    ["Wir suchen ca. 20 Leute, z. B. für den Einkauf.", "Seit dem 4. Oktober 2019 leitet Dr. Alt den 1. FC Lager.", "Tel. 030 123.", "Im Schnitt dauert es 3 Tage; danach melden wir uns."],
    ["Die Antwort lautet: „Das hängt davon ab.“", "„Wir liefern!“, sagt Udo."],
    ["M. Roy et Mme Lac p. ex. à Lyon\xa0: qui vient\xa0?", "«\xa0Oui\xa0!\xa0» dit-il.", "C’est simple… ou presque."],
    ["¿Por qué ahora?, se preguntarán.", "—Nadie viene —dice Ana.", "Trabaja en EE. UU. y en la Av. Olmo, núm. 8."],
    ["В офисе есть душ и т. д.", "«Не спеши. Но и не стой», — говорит А. В. Лосева.", "Хотите работать в г. Томск?"],
    ["Γιατί τώρα;", "Ο κ. Μαρλής μιλά, π.χ. με τη Δρ. Δενδρινού.", "Τέλος."],
    ["डॉ. विनीत आएंगे।", "क्या आप आएंगे?", "“हम बदलाव करते हैं।” ऐसा तारा कहते हैं।"],
    ["يقود د. هالة المقابلة.", "قال نورا: «نطلق كل أسبوع.» في اللقاء.", "لماذا الآن؟"],
    ["คุณอยากทำงานที่ภูเก็ตหรือไม่", "ทีมของเราใช้ Murrow ทุกวัน", "บริษัทมีพนักงาน 31 คนและเติบโตเร็ว", "ทีมที่ภูเก็ตดูแลแอปมือถือร่วมกับ Calderis", "Orbvadon Labs เปิดสำนักงานใหม่ที่ขอนแก่น", "คุณ Lars Nevolna จะเป็นผู้สัมภาษณ์รอบแรก"],
]
DENSE = [
    ["面接は7回（オンライン可。）です。", "「変えたい。」と高瀬さんは話します。", "40か月かかりました……でも価値がありました。", "なぜですか？"],
    ["《别急。但别停。》是内部手册。", "“我们每周都发布！”陆衡说。", "时间不多了……但我们仍在等你。"],
]


def cut(text):
    return [text[s:e] for s, e in sentence_spans(text)]


@pytest.mark.parametrize("parts", CASES)
def test_sentences_with_spaces(parts):
    for gap in (" ", "  ", "\n\n"):
        assert cut(gap.join(parts)) == parts


@pytest.mark.parametrize("parts", DENSE)
def test_sentences_without_spaces(parts):
    assert cut("".join(parts)) == parts
    assert cut("　".join(parts)) == parts


def test_lists_headings_and_breaks():
    text = "﻿Your profile\r\n\r\n- 3 years with Foo\r\n1. Remote within Leeds. Travel is rare.\r\n* One\n* Two.\nTail without mark\n\nNext"
    assert cut(text) == ["Your profile", "- 3 years with Foo", "1. Remote within Leeds.", "Travel is rare.", "* One", "* Two.", "Tail without mark", "Next"]


def test_hard_wrapped_lines_are_joined():
    text = "Our team in Berlin grew from 25 to 378 people last year and it will not\nstop there. The next office opens in Lyon, where we hire for the whole of\nsales.\n\nBenefits\n- A bike"
    assert [" ".join(u.split()) for u in cut(text)] == ["Our team in Berlin grew from 25 to 378 people last year and it will not stop there.", "The next office opens in Lyon, where we hire for the whole of sales.", "Benefits", "- A bike"]


def test_missing_spaces():
    assert cut("It rarely sleeps.Dr. Lee will come.Das Büro liegt hier.") == ["It rarely sleeps.", "Dr. Lee will come.", "Das Büro liegt hier."]


def test_units_cover_everything():
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice(["a", "B", ".", "!", "?", "…", " ", "\n", "“", "”", "(", ")", "«", "»", "。", "「", "」", "1", "- ", "etc.", '"', "🚀", ";", "ไ", "﻿"]) for _ in range(rng.randint(0, 40)))
        spans, last = sentence_spans(text), 0
        for s, e in spans:
            assert last <= s < e and not text[s].isspace() and not text[e - 1].isspace() and text[s] != "﻿" and text[e - 1] != "﻿"
            assert not text[last:s].replace("\ufeff", "").strip()
            last = e
        assert not text[last:].replace("\ufeff", "").strip()


def test_query_over_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, " \n　", "c"), (4, "Go on. So be it.", "c"), (4, "Go on. So be it.", "c"), (5, "word " * 20000, "c")], "doc_id long, text string, sent_start string")
    got = sorted(tuple(r) for r in sentence_units(docs).collect())
    assert got == [(4, 0, 6), (4, 0, 6), (4, 7, 16), (4, 7, 16), (5, 0, 99999)]
    assert sentence_units(docs.limit(0)).count() == 0


def test_wrapping_of_any_width_is_recognised():
    english = "The team of the company worked for several months on a set of tools which were meant to help all of the customers in their daily work with the data platform and the reports it makes."
    german = "Wir suchen für unser Team in Köln eine Person mit Erfahrung in der Planung von Lagern, die Freude an Zahlen hat und Kunden in ganz Europa berät."
    hindi = "पिछले कई महीनों से हमारी टीम ग्राहक सहायता और भंडार योजना पर काम कर रही है और हम इंदौर में एक नया साथी खोज रहे हैं जो हमारे साथ काम करे।"
    for text in (english, german, hindi):
        for width in (20, 30, 40, 48, 60, 80, 100, 110, 130):
            assert len(cut("\n".join(textwrap.wrap(text, width)))) == 1, (width, text)
    chinese = "我们的团队在过去的几个月里一直在为客户开发新的工具这些工具可以帮助他们更好地使用数据平台和各种报告。"
    assert len(cut("\n".join(textwrap.wrap(chinese, 12)))) == 1


def test_lines_that_are_not_wrapped_stay_apart():
    assert cut("One long line that has no mark and goes on for a while\nAnd then a second one that stands alone\nA third\nThe last line of them all is no longer than the first") == [
        "One long line that has no mark and goes on for a while", "And then a second one that stands alone", "A third", "The last line of them all is no longer than the first",
    ]
    assert len(cut("高瀬さんは大阪のチームで検索機能を見ています\nVexromontでは請求を担当する方を募集しています。")) == 2


def test_items_with_a_hanging_indent():
    text = "Wanted:\n- Skill in planning,\n  also of small teams. Travel is rare.\n  - Lyon\n    and Paris\n  - Leeds\n- A bike\nApply"
    assert [" ".join(u.split()) for u in cut(text)] == ["Wanted:", "- Skill in planning, also of small teams.", "Travel is rare.", "- Lyon and Paris", "- Leeds", "- A bike", "Apply"]


def test_long_look_backs():
    assert cut("Am " + " " * 40 + "3. Mai geht es los. Gut.")[0].endswith("los.")
    assert cut("Τι είναι το " + "Brindle " * 12 + "; Δεν ξέρω.")[1] == "Δεν ξέρω."
