"""Random answers: the generator knows which of them are records."""

import json
import random

from sitelens.functions import answers as A
from sitelens.schemas import ANSWER_FIELDS, FIELD_KEYS


VALUES = ["text", "", "многострочный\nтекст", 'quote " inside', "tab\tchar", 12, 1.5, True, None, ["a"], {"k": "v"},
          "emoji 🙂", "back\\slash"]


def _answer(rnd):
    """(raw text, the record's fields or None): fields are strings or the answer is no record."""
    keys = rnd.sample(FIELD_KEYS, rnd.randrange(0, 24)) + (["extra"] if rnd.random() < 0.2 else [])
    obj = {k: (rnd.choice(VALUES) if rnd.random() < 0.3 else f"v{rnd.randrange(99)}") for k in keys}
    s = json.dumps(obj, ensure_ascii=rnd.random() < 0.5)
    record = {c: obj.get(k, "") for c, k in ANSWER_FIELDS}
    good = all(isinstance(v, str) for v in record.values())
    shape = rnd.randrange(5)
    if shape == 1:
        s = "```json\n" + s + "\n```"
    elif shape == 2:
        s = "Ответ: " + s + " конец"
    elif shape == 3:
        s, good = s[:-1], False  # the closing brace is gone
    return s, record if good else None


def test_random_answers(spark):
    rnd = random.Random(17)
    answers = [_answer(rnd) for _ in range(300)]
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(answers)], "i long, raw string")
    for r in A.with_answer_fields(df.withColumn("j", A.json_unwrap("raw")), "j").collect():
        raw, record = answers[r.i]
        assert r.parse_ok == (record is not None), raw
        if record is not None:
            assert {c: r[c] for c in record} == record, raw
