import pytest

from fixturelake.llm.residue import default_slots, filler, page_mask, residue, whole_page

REAL = "Maçın sonucu 51 - 8; teknik faul yok, sakatlık bir. Takım listeleri %56 oranında tamam, kalanlar yarına."
BAD = {
    "slots": "Sayın {{ad_soyad}}, ${tarih} tarihli maça atandınız.", "one slot": f"{REAL} Salon <venue> kapalı.", "guillemets": f"{REAL} «tarih» günü.", "buraya": "Hakem: [ad_soyad BURAYA]",
    "defaults": "Maçınız undefined - undefined saat undefined itibarıyla undefined salonunda.", "refs": "🏀 #REF! - #REF!\n🏟️ #REF!", "lorem": "Ipsum velit elit amet nunc sit porta ante mauris sed lorem vitae.",
    "said over": "buraya metin gelecek, BURAYA METİN GELECEK, buraya metin gelecek, buraya metin gelecek", "keys": "asdf asdf asdf asdf asdf", "after content": f"{REAL}\n\ntest test. test test. test test. test test.",
    "404": "404 | İçerik kaldırılmış ya da adı değişmiş.\n« Geri dön", "script": "Please enable JavaScript and cookies to continue.", "session": "Oturumunuzun süresi doldu, lütfen yeniden giriş yapın.", "html": "<html><head><title>429</title></head><body><h1>Hata</h1><hr></body></html>",
    "trace": "Error: cannot read property 'x' of undefined\n    at run (job.js:9:7)", "python": "Traceback (most recent call last):\n  File \"a.py\", line 3, in f\nValueError: bad", "form": "RAPOR NO: ......\nMAÇ: ........ - ........\nSALON: ........", "todo": "TODO: özet\nTODO: skor",
    "fields": "<Takım A> - <Takım B>\n<Salon adı> / <Saat>", "invite": "Başlık giriniz\nAlt başlık giriniz\nMetin eklemek için tıklayın", "wide": "Bu sayfayı görüntülemek için JavaScript'i etkinleştirin.",
}
GOOD = {
    "null": None, "empty": "", "blank": " \n\t", "real": REAL, "quoted slot": "Şablondaki '{mac_adi}' alanı artık takım adlarıyla doluyor.", "marks": "Listede [yedek] yazan 63 kişi arandı, <acil> işaretli 7 satır önce dolduruldu; %s yerine %d yazan rapor kalmadı.",
    "error told": "Dün bildirim servisi bir süre 404 hatası verdi, sorun 12:50 sularında giderildi; o sırada atanan 47 hakem telefonla arandı.", "refs told": "Tabloda #REF! görünen 53 hücre düzeltildi. Tabloda #REF! görünen 9 hücre düzeltildi.",
    "session told": "The error page seen on 30 Ekim came from an expired session; all 27 reports were saved and sent again.", "invite told": "Toplantıda 'metni buraya yazınız' ibaresinin formdan kalkması kararlaştırıldı, yeni formu Ömür hazırlayacak.",
    "null told": "Hakem hatası oranı %19 düzeyinden %2 düzeyine indi; null skorlu maç kalmadı.", "script told": "Web ekibi, tarayıcıda JavaScript kapalı olan üyeler için basit bir sayfa hazırladı.", "set": "Grup eşleşmeleri {U14, U16} kümesinden 36 takımla yapıldı.",
    "deneme": "Deneme maçı oynandı, deneme metni okunan anons beğenilmedi.", "table": "| gün | saat |\n| 1 | 10:00 |\n| 1 | 10:00 |", "rule": "========", "doors": "Salonun 500 kişilik tribünü doldu, 403 numaralı kapı kapatıldı.",
}


def test_found_and_left(rows):
    corpus = [{"doc_id": 500 + i, "text": t} for i, t in enumerate(["Maç: {{venue}}", "Yer: ${venue}", "Gün: {{ tarih }}", "Gün: @@tarih@@"])]
    docs = [{"doc_id": i, "text": t} for i, t in enumerate([*BAD.values(), *GOOD.values()])]
    got = {r.doc_id for r in residue(rows("doc_id long, text string, reason int, name string, page string", *docs, *corpus), "doc_id", "text").collect()}
    names = [*BAD, *GOOD]
    assert {names[i] for i in got if i < 500} == set(BAD)
    assert {i for i in got if i >= 500} == {500, 501, 502, 503}


def test_an_empty_table_and_a_very_long_text(rows):
    df = rows("doc_id long, text string", {"doc_id": 1, "text": (REAL + " ") * 3000}, {"doc_id": 2, "text": (REAL + " ") * 3000 + "{{ad_soyad}}"})
    assert {r.doc_id for r in residue(df, "doc_id", "text").collect()} == {2}
    assert residue(df.limit(0), "doc_id", "text").count() == 0


def test_one_strong_placeholder_is_enough(rows):
    docs = ["Top ${TARIH} elinde kaldı.", f"{REAL} Salon <tarih> kapalı.", f"{REAL} {{{{crew}}}}", f"{REAL} [nöbetçi] yazıldı.", "Şablondaki '${saat}' alanı doluyor.", f"{REAL} <saat> işareti."]
    df = rows("doc_id long, text string", *({"doc_id": i, "text": t} for i, t in enumerate(docs)))
    assert {r.doc_id for r in residue(df, "doc_id", "text").collect()} == {0, 1, 2}
    assert {r.doc_id for r in residue(df.where("doc_id = 2"), "doc_id", "text").collect()} == {2}


@pytest.mark.parametrize("text,kind", [
    ("Error: " + "x y " * 150 + "\n    at run (job.js:9:7)", "trace"), ("Exception in thread main\n" + "\n".join(f"    at a.b{i} (c.js:{i}:1)" for i in range(90)), "trace"),
    ("Traceback (most recent call last):\n" + "  File \"a.py\", line 3, in f\n    return g(x)\n" * 40 + "ValueError: bad", "trace"),
    ("MAÇ: " + "." * 500 + "\nSALON: ......\nSAAT: ......", "form"), ("Bu form maçtan sonra doldurulur. " * 15 + "\nMAÇ: .....\nSALON: .....\nSAAT: .....\nSKOR: .....", "form"),
    ("Sayfa bulunamadı, aradığınız sayfa kaldırılmış olabilir. " * 100, "page"), ("Sayfa bulunamadı. " + (REAL + " ") * 50, None), ("The page you requested could not be found", "page"),
    ("MAÇ: A - B\nSALON: .....\nSAAT: .....\nSKOR: .....\nNOT: .....", None), ("Giriş " + "." * 200 + " 5", None), ("Sayfa bulunamadı &mdash; 404", "page"), ((REAL + " ") * 9 + "\nError: bad\n    at run (job.js:9:7)", None),
])
def test_long_pages(text, kind):
    assert whole_page(text) == kind


def test_masks_of_ordinary_length():
    page = "Hata 503: sunucu yanıt vermedi, tekrar deneyin. " + "Sunucu hatası 503, yeniden deneyin. " * 2 + "Kayıt no {0} tutuldu, destek ekibi konuyu bugün inceleyecek ve sonucu bildirecek. " * 3
    assert 300 < len(page) <= 700 and page_mask(page.format(101)) == page_mask(page.format(102)) is not None


@pytest.mark.parametrize("line", ["15-15-15 sona erdi", "yok, yok dediler", "A - A"])
def test_ordinary_repeats(line):
    assert not filler(line) and not default_slots(line) and whole_page(line) is None


SLOTS = ["Sayın Ahmet Kaya, 12.05.2026 günü Kadıköy salonunda saat 18:30 için görevlisiniz.", "Sayın Elif Demir, 13.05.2026 günü Beşiktaş salonunda saat 10:00 için görevlisiniz.", "Sayın Can Su, 01.04.2026 günü Moda salonunda saat 12:15 için görevlisiniz.",
         "Sayın Naz Er, 2 Mayıs günü Fikirtepe salonunda saat 9.30 için görevlisiniz.", "Sayın Ömer Faruk Ak, 30.05.2026 günü Koşuyolu Spor salonunda saat 20:00 için görevlisiniz."]
LEFT = ["Sayın undefined, 12.05.2026 günü Kadıköy salonunda saat 18:30 için görevlisiniz.", "Sayın , 14.05.2026 günü Moda salonunda saat 11:30 için görevlisiniz.", "Sayın ......, 12.05.2026 günü ...... salonunda saat 18:30 için görevlisiniz.",
        "Sayın AD_SOYAD, 12.05.2026 günü SALON_ADI salonunda saat 18:30 için görevlisiniz."]
FRENCH = "Erreur du serveur. La page demandée est introuvable, veuillez réessayer plus tard."


def test_slots_found_by_aligning_records(rows):
    told = ["Hakem hatası düzeyi indi; null skorlu maç kalmadı.", "Bu ay hakem hatası düzeyi indi; null skorlu maç kalmadı.", "Kadro , dün akşam açıklandı ve liste asıldı.", "Tabloda #REF! görünen 53 hücre düzeltildi.", "Tabloda #REF! görünen 9 hücre düzeltildi."]
    pages = [FRENCH] * 3 + ["Die Uhr blieb auf der Seite stehen."] * 3 + ["Die Uhr blieb auf der Seite stehen. Danach ging es weiter.", "The page you requested could not be found"]
    for pad in ("", REAL + " "):
        docs = [pad + t for t in SLOTS + LEFT + told] + pages
        df = rows("doc_id long, text string, _id int, _seg string", *({"doc_id": i, "text": t} for i, t in enumerate(docs)))
        got = {docs[r.doc_id] for r in residue(df, "doc_id", "text").collect()}
        assert got == {pad + t for t in LEFT} | {FRENCH, pages[-1]}


def test_every_wording_holds_a_stem():
    from re import _parser

    from fixturelake.llm.residue import PAGES, stemmed

    def shortest(tree):
        """Texts with every choice of the pattern taken once and nothing optional."""
        out = [""]
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                parts = [chr(arg)]
            elif name == "BRANCH":
                parts = [x for t in arg[1] for x in shortest(t)]
            elif name == "SUBPATTERN":
                parts = shortest(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                parts = [x * arg[0] for x in shortest(arg[2])] if arg[0] else [""]
            elif name == "IN":
                parts = [next((chr(v) for o, v in arg if str(o) == "LITERAL"), "0")]
            elif name == "AT":
                parts = [""]
            else:
                parts = ["0"]
            out = [a + b for a in out for b in parts]
        return out

    assert all(stemmed(x.upper()) and stemmed(x) for p in PAGES for x in shortest(_parser.parse(p)))


def test_texts_are_read_twice(rows, tmp_path):
    there = str(tmp_path / "read")

    def counted(batches):
        for b in batches:
            with open(there, "a") as f:
                f.write("".join(f"{i}\n" for i in b.column(0).to_pylist()))
            yield b

    df = rows("doc_id long, text string", *({"doc_id": i, "text": t} for i, t in enumerate([*SLOTS, *LEFT, *[FRENCH] * 3, REAL])))
    got = {r.doc_id for r in residue(df.repartition(4).mapInArrow(counted, df.schema), "doc_id", "text").collect()}
    assert got == {*range(len(SLOTS), len(SLOTS) + len(LEFT) + 3)}
    read = open(there).read().split()
    assert sorted(read) == sorted([str(i) for i in range(len(SLOTS) + len(LEFT) + 4)] * 2)


def test_templates_and_pages_too_many_to_know_are_joined(rows, monkeypatch):
    from fixturelake.llm import residue as module

    monkeypatch.setattr(module, "KNOWN_ROWS", 0)
    copied = "Der Server hat die Seite verloren."
    docs = [*SLOTS, *LEFT, *[FRENCH] * 3, *[copied] * 3, f"{REAL} {copied} Danach ging es weiter.", REAL]
    df = rows("doc_id long, text string", *({"doc_id": i, "text": t} for i, t in enumerate(docs)))
    assert {docs[r.doc_id] for r in residue(df, "doc_id", "text").collect()} == {*LEFT, FRENCH}


@pytest.mark.parametrize("seg", [
    *SLOTS, *LEFT, *GOOD["marks"].split(". "), "Kaya Spor [object Object] [Object object]. x[object Object]", "A.Ş. ile A.B_c ve a.b_c, eTicket Ⅷ x² 3x3", "( Kaya ) Ali'nin (Can Su), 12.05.2026-Moda", "İ I ı É. \x0b Ali \f Can", "\ue000 Ali Can ¤ ¶ Naz", "", "Ali", "ali %s %d n/a nUll undefıned",
])
def test_values_of_tokens_are_those_of_the_sentence(seg):
    from fixturelake.llm.residue import _REGIONS, aligning

    assert aligning(seg) == (_REGIONS.sub("¤", seg), _REGIONS.findall(seg))
