import pytest

from millrace.llm import answers as A

Q = "What is the median number of sacks of meal among the mills of the Drubradal reach?"
CASES = [
    (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("...", "empty"), ("12", None), ("-3.5", None), ("About 12 sacks of meal", None), ("The answer is 12.", None), ("The answer is 12", None), ("eleven", None),
    ("I am unable to provide an estimate.", "refusal"), ("Unfortunately, I don't know", "refusal"), ("Das kann ich leider nicht beantworten.", "refusal"), ("Не могу ответить на этот вопрос.", "refusal"), ("I would rather not guess from 12 short notes alone.", "refusal"),
    ("I can't be certain, but about 12 seems right.", None), ("Sorry for the short reply: 98.", None), ("It cannot be less than 20, so I would settle on 25.", None),
    (Q, "copy"), (Q.lower() + "\nAnswer:", "copy"), ("median number of sacks of meal among the mills of the Drubradal reach", "copy"), (Q + " 12.", None), (Q + " " + Q, "copy"),
    ("Je dirais que la valeur est proche de 12.", "other_language"), ("Я бы сказал, что значение около 12.", "other_language"), ("Im Durchschnitt sind es etwa 12.", "other_language"),
    ("It cannot be less than 20, so I wou", "truncated"), ("Going by the notes, the", "truncated"), ("The value (from the", "truncated"), ("Roughly 20,", None),
]
CORPUS = ["It cannot be less than 7, so I would settle on 9.", "I can't be certain, but about 5 seems right.", "Hard to say exactly; 7 is my guess."] * 3


def judged(spark, rows):
    df = spark.createDataFrame([(i, a, q, "x") for i, (a, q) in enumerate(rows)], "record_no long, answer string, question string, defect string")
    return {r["record"]: r["defect"] for r in A.defective_pairs(df, "record_no", "answer", "question").collect()}


def test_cases(spark):
    got = judged(spark, [(a, Q) for a, _ in CASES] + [(c, Q) for c in CORPUS])
    assert {CASES[i][0]: got.get(i) for i in range(len(CASES))} == dict(CASES)


def test_whole_answers_without_a_stop_are_learned_from_the_corpus(spark):
    rows = [(c, Q) for c in CORPUS] + [("I can't be certain, but about 8 seems right", Q), ("Hard to say exactly; 8 is my guess", Q), ("Hard to say exactly; 8 is my gu", Q), ("It cannot be less than 8", Q)]
    n = len(CORPUS)
    assert judged(spark, rows) == {n + 2: "truncated", n + 3: "truncated"}


def test_null_questions_and_empty_tables(spark):
    assert judged(spark, [("Je dirais que la valeur est proche de 12.", None), (None, None), ("x" * 100_000 + ".", "")]) == {1: "empty"}
    assert judged(spark, []) == {}


@pytest.mark.parametrize("text, want", [("a (b) c", False), ("a (b", True), ("```\nx", True), ("```\nx (\n```", False), ("he said “no”", False), ("he said “no", True), ("a [b (c] d", False), ("1. one\n2. ", True), ("say \"x\"", False),
    ("<table><tr><td>5 crates.", True), ("<b>5</b> crates<br>.", False), ("see <a href=\"x\"", True), ("a < b and c", False), ("**The value", True), ("**5** crates", False), ("2 ** 3", False), ("tide__mill is __one", True), ('5" tall.', False), ('a "5" tall', False), ('he said "5 tall', True), ("`a (`", False), ("x) y", False),
    ("“" + "a b. " * 300 + "”", False), ("“" + "a b. " * 300, True)])
def test_pushdown(text, want):
    assert A.left_open(text) is want


def test_tiling():
    assert A.tiles("a b c d e f".split(), "x a b c y d e f".split()) == 6
    assert A.tiles("a b c a b c".split(), "a b c".split()) == 3
    assert A.tiles("a b".split(), "a b".split()) == 0


REFUSALS = """I must decline.|My lips are sealed on this matter.|Sorry, no.|Ich schweige dazu.|Je ne dirai rien.|No idea.|I haven't the faintest idea.|We are not in a position to share that.|It's impossible for me to say.|I'd prefer to stay silent.|The answer is unknown to me.
That is beyond my knowledge.|Apologies, but I refuse.|Keine Ahnung.|Darüber darf ich keine Auskunft geben.|Das entzieht sich meiner Kenntnis.|Ich verzichte auf eine Schätzung.|Aucune idée.|Je refuse de répondre.|Il m'est impossible de donner un chiffre.|Je n'ai pas assez d'informations.
Ni idea.|Me niego a contestar.|No quiero dar una cifra.|Non ne ho idea.|Mi rifiuto di rispondere.|Non saprei dirlo.|Não faço ideia.|Recuso-me a responder.|Prefiro ficar calado.|Geen idee.|Ik weiger te antwoorden.|Ik weet het niet.|Ingen aning.|Det vet jag inte.|Jag vägrar svara.
Понятия не имею.|Отказываюсь отвечать.|Мне это неизвестно.|Я не скажу.|I lack the data to say.|Without more data I cannot tell.|I'm not willing to speculate.|My guidelines forbid me to answer.|I won't.|No comment.""".replace("\n", "|").split("|")
WHOLE = """The typical value is seven.|No fewer than seven mills have it.|It is not far from eight.|Etwa sieben, nicht mehr.|Pas plus de huit.|No más de diez.|Non più di otto.|Não mais de nove.|Niet meer dan zes.|Inte mer än fem.|Не больше семи.
We counted twelve and no more.|The keeper says eleven.|I think it is around forty.|I know it: twenty.|My answer is twelve.|Beyond the mill there are nine.|The lake is silent and holds ten boats.""".replace("\n", "|").split("|")


@pytest.mark.parametrize("text, want", [(t, "refusal") for t in REFUSALS] + [(t, None) for t in WHOLE])
def test_refusals_by_the_grammar(text, want):
    got = A.Reader().read(text, None)[0]
    assert (got == "refusal") is (want == "refusal")


def test_a_noisy_ending_does_not_clear_the_cut_answers(spark):
    rows = [("I would say that the", Q)] * 120 + [("I would say that the.", Q)] + [("It is about eight in all", Q)] * 40 + [("It is about eight in all.", Q)] * 3
    got = judged(spark, rows)
    assert got == {i: "truncated" for i in range(120)}


def test_an_ellipsis_after_a_word_is_looked_up(spark):
    assert judged(spark, [(c, Q) for c in CORPUS] + [("It cannot be less than 20, so I would…", Q), ("I can't be certain, but about 5 seems right...", Q)]) == {len(CORPUS): "truncated"}
