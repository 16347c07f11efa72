from actmill.llm import pairs as pa

Q = "Kur duhet të paguajë subjekti tatimin mbi vlerën e shtuar për muajin mars?"
OK = "Subjekti paguan tatimin mbi vlerën e shtuar deri në datën katërmbëdhjetë të muajit pasardhës dhe mban dokumentet [1]."


def run(spark, rows):
    a = spark.createDataFrame([(i, *r, "z") for i, r in enumerate(rows)], "answer_id long, question string, answer string, should_refuse boolean, defect string")
    s = [(0, "sq", Q + " " + OK), (1, "en", "When must the taxpayer pay the value added tax for the month of March? The taxpayer pays the tax before the fourteenth day of the following month and keeps the documents.")]
    return {r.answer_id: r.defect for r in pa.defects(a, spark.createDataFrame(s, "sample_id int, lang string, text string")).collect()}


def test_one_defect_each(spark):
    rows = [
        (Q, OK, False), (Q, None, False), (Q, " [1] … ", None), (Q, "N/A", True), (Q, "Pyetja: “" + Q.upper() + "”", False), (Q, Q + " " + Q, False), (Q, "Më vjen keq, nuk jam në gjendje ta trajtoj këtë çështje. Provoni një pyetje tjetër.", False),
        (Q, "Më vjen keq, nuk jam në gjendje ta trajtoj këtë çështje.", True), (Q, "Duhet ta lë këtë pa përgjigje.", None), (Q, "The taxpayer pays the tax before the fourteenth day of the following month and keeps the documents.", False),
        (Q, "Subjekti paguan tatimin mbi vlerën e shtuar deri në dat", False), (Q, "Subjekti paguan tatimin mbi vlerën e shtuar nuk mund të zbresë shumën.", False), (None, OK, False), (Q, OK + " " + Q, False),
    ]
    assert run(spark, rows) == {1: "empty", 2: "empty", 3: "empty", 4: "copy", 5: "copy", 6: "refusal", 9: "other_language", 10: "truncated"}
    assert run(spark, []) == {}


def test_alignment():
    a, b = list("abcbdab"), list("bdcaba")
    assert pa.common(a, b) == 4 and pa.common([], b) == 0
    assert pa.tokens("Ｋｕｒ  pаguhet​?") == ["kur", "paguhet"]


def test_refusals_in_wordings_of_no_list(spark, monkeypatch):
    """Learnt on one half of the labelled answers, found in the other half; the composed templates are left out."""
    monkeypatch.setattr(pa, "COMPOSED", ())
    rows = spark.read.parquet("/root/testdata/sf0.1/answers.parquet").filter("answer is not null")
    refusals = pa.Refusals(pa.learn_refusals(rows.filter("answer_id % 2 = 0")))
    rest = rows.filter("answer_id % 2 = 1").collect()
    found = [refusals.among(pa.plain(r.answer)) for r in rest]
    right = [f for r, f in zip(rest, found) if r.should_refuse and r.refused]
    wrong = [f for r, f in zip(rest, found) if r.should_refuse is False and not r.refused]
    assert len(right) > 40 and sum(right) / len(right) >= 0.9 and sum(wrong) / len(wrong) <= 0.01


def test_lead_in_is_within_the_sentence():
    q = pa.tokens(Q)
    assert pa.lead_in(q, "Ju keni pyetur, nëse e kuptova mirë dhe pa shtuar asgjë tjetër nga ana ime: " + Q) == 15
    assert pa.lead_in(q, "Po. " + Q) == 0 and pa.lead_in(q, Q) == 0 and pa.lead_in([], Q) == 0
