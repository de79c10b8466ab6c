import json

from lodeworks.sources import sheets as S


def write(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_questions_below_other_rows(spark, tmp_path):
    path = write(tmp_path / "q", {
        "a.csv": 'Study of suppliers\n,,\nmade by us,"2,5"\n#,Sample Query,,Answer,Facts\n1.0,Who makes  packs?,x,"Acme, Bolt",\n,Which are in Rome?,,,one\n7,Hm?,,no,\n,,,,\n,"Say ""why"" not?",,,\n',
        "b.csv": "q_id,question\nQ9,What is it?\n\nQ10,And this one?\n",
        "c.csv": "no,header\nat,all\n",
        "d.csv": "\n".join(["x,y"] * 12 + ["question,id", "Too late a header,1"]),
        "empty.csv": "",
    })
    got = {(r.file.rsplit("/", 1)[1], r.nth): (r.q_id, r.question, r.expected_answer, r.key_facts) for r in S.questions(spark, path).collect()}
    assert got == {
        ("a.csv", 1): ("1", "Who makes packs?", "Acme, Bolt", None), ("a.csv", 2): ("2", "Which are in Rome?", None, "one"), ("a.csv", 5): ("5", 'Say "why" not?', None, None),
        ("b.csv", 1): ("Q9", "What is it?", None, None), ("b.csv", 2): ("Q10", "And this one?", None, None),
    }


def test_large_file_in_parts(spark, tmp_path):
    path = write(tmp_path / "q", {"a.csv": "notes\n" + "id,question\n" + "".join(f",question number {i}\n" for i in range(20_000))})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        got = {r.q_id: r.question for r in S.questions(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {str(i + 1): f"question number {i}" for i in range(20_000)}


def test_json_questions(spark, tmp_path):
    path = write(tmp_path / "j", {
        "list.json": json.dumps([{"q_id": "a", "question": "Who is there?", "expected_answer": "me"}, {"id": 4, "prompt": "What is this?"}, {"query": "no"}, {"query": "Where is it?", "key_facts": "f"}]),
        "object.json": json.dumps({"questions": [{"question": "Is it so?"}], "title": "t"}),
        "map.json": json.dumps({"x1": "First of all?", "x2": "Hm"}),
    })
    got = sorted((r.file.rsplit("/", 1)[1], r.nth, r.q_id, r.question, r.expected_answer, r.key_facts) for r in S.json_questions(spark, path).collect())
    assert got == [("list.json", 1, "a", "Who is there?", "me", None), ("list.json", 2, "4", "What is this?", None, None), ("list.json", 4, "4", "Where is it?", None, "f"), ("map.json", 1, "x1", "First of all?", None, None), ("object.json", 1, "1", "Is it so?", None, None)]


def test_rows_and_notes(spark, tmp_path):
    path = write(tmp_path / "s", {"data.csv": "Company,Category,Location\nAcme,Tier 1,\n,,\nBolt,,Rome\n", "note.csv": "Definitions,\nTier 1 is first,one\n,two\nTier 2 is next,\n"})
    rows, notes = S.rows_and_notes(spark, path)
    assert sorted((r.nth, tuple(sorted(r["values"].items()))) for r in rows.collect()) == [(1, (("Category", "Tier 1"), ("Company", "Acme"))), (2, (("Company", "Bolt"), ("Location", "Rome")))]
    assert [r.text for r in S.note_texts(notes).collect()] == ["Tier 1 is first\nTier 2 is next\none\ntwo"]


def test_lists_and_references(spark, tmp_path):
    path = write(tmp_path / "l", {"a.csv": "n,Question\n1,Who is it?\n2,Who is it?\n3,What now?\n", "b.csv": "anything\nThe first column\nThe first column\n"})
    assert sorted((r.nth, r.question) for r in S.question_list(spark, path).collect()) == [(1, "The first column"), (1, "Who is it?"), (3, "What now?")]
    path = write(tmp_path / "r", {"a.csv": "Question,x,Golden_Answer\nWho is it?,1,me\nWho is it?,2,you\nWhat now?,,\n", "b.csv": "query,text\nWhat else?,that\n", "c.csv": "a,b\nno question,here\n"})
    assert sorted((r.question, r.answer) for r in S.reference_answers(spark, path).collect()) == [("What else?", "that"), ("Who is it?", "you")]
