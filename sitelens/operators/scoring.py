"""Prompt requests (R-11) and batch scoring with an injected model (R-13).

The per-audit model call becomes a batch: one prompt row per request, scored
partition by partition in ``mapInPandas``. The client is built once per
partition by an injected factory (tests inject a deterministic stub; the
vendor client is not part of this package). Failed calls are retried
``attempts`` times and then reported in an ``error`` column instead of
failing the task, so one bad row never sinks a partition.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The system prompt and the user template sent with every page.
SYSTEM_PROMPT = """
Ты — аналитик маркетинговых лендингов. Твоя задача — извлечь информацию ТОЛЬКО из переданных текстов страниц и вернуть СТРОГИЙ JSON со строго заданными полями на русском языке.

Жёсткие правила:
1) Анализируй только явно видимый текст из входных данных (HOME_TEXT и PRICING_TEXT, если есть). Не додумывай факты, которых нет в тексте.
2) Если чего-то нет в тексте — заполни поле пустой строкой "" (не пиши "нет данных" и т.п.).
3) Для цен обязательно укажи источник: "главная" или "цены: <URL>" — если PRICING_TEXT дан и URL известен.
4) Боли ЦА — минимум 7 пунктов; допускается пометка [предп], если вывод логичен из текста.
5) FAQ — выбери 10–15 ключевых вопросов (и ответы, если видны).
6) "Структура главной" — перечисли блоки сверху вниз в формате: "Блок: [точный заголовок/описание] — [что содержит]".
7) Верни СТРОГО JSON без комментариев и без лишних полей. НИКАКИХ пояснений, кода, разметки — только JSON.

Список ключей JSON (все значения — строки; список пунктов допускается оформлять как многострочный текст с маркерами "- "):
- "Оффер (первый экран)"
- "CTA (первый экран)"
- "УТП (по формуле)"
- "Продукт / услуги (кратко)"
- "Программа обучения"
- "Все CTA (текст + контекст)"
- "Выгоды"
- "Боли ЦА"
- "Цены и тарифы (с источником)"
- "Рассрочка / Оплата позже"
- "Акции (условия/сроки)"
- "Бонусы / Подарки"
- "Гарантии"
- "Факторы доверия"
- "Лид-магниты / Квизы"
- "Контакты и соцсети"
- "Онлайн-чат (наличие/тип/расположение)"
- "Формы заявки (поля/кнопки)"
- "Структура главной (сверху вниз)"
- "FAQ (10–15 ключевых)"
- "Маркетинговые выводы"
- "Гипотезы роста (SMART)"
- "Краткая сводка (3–4 пункта)"
- "Заметки (служебно)"

Дополнительно:
- Если подозреваешь, что страница требует JS-рендеринга (мало контента или типичные признаки SPA), укажи это в "Заметки (служебно)" фразой: "Возможен JS-рендеринг".
- "Краткая сводка (3–4 пункта)" — сделай 3–4 ёмких маркерных тезиса о самом важном.
"""

USER_TEMPLATE = """
Дано две строки текста:
HOME_TEXT (главная страница):
---
{HOME_TEXT}
---

PRICING_TEXT (страница цен, если есть):
---
{PRICING_TEXT}
---

PRICING_URL (если есть): {PRICING_URL}

ЗАДАНИЕ:
Проанализируй только видимый текст. Верни СТРОГО JSON с ключами ровно из списка, без лишних полей и лишних пояснений.
Напомню, для "Цены и тарифы (с источником)" укажи источник: "главная" или "цены: {PRICING_URL}" (если PRICING_TEXT есть). 
"Боли ЦА" — минимум 7 пунктов (допускай [предп], если логично).
"FAQ (10–15 ключевых)" — не более 15.
"Краткая сводка (3–4 пункта)" — ровно 3–4 маркерных тезиса.

Верни только JSON.
"""
# ---------------------------------------------------------------------------

_PLACEHOLDERS = ["{HOME_TEXT}", "{PRICING_TEXT}", "{PRICING_URL}"]


def template_pieces(template: str = USER_TEMPLATE) -> list[tuple[str, str | None]]:
    """Split a template into (literal, placeholder-or-None) pieces."""
    out, rest = [], template
    while True:
        hits = [(rest.find(p), p) for p in _PLACEHOLDERS if rest.find(p) >= 0]
        if not hits:
            out.append((rest, None))
            return out
        i, p = min(hits)
        out.append((rest[:i], p))
        rest = rest[i + len(p):]


def user_prompt(home, pricing_text, pricing_url) -> Column:
    """R-11: the user prompt; null texts become ''."""
    vals = {"{HOME_TEXT}": home, "{PRICING_TEXT}": pricing_text, "{PRICING_URL}": pricing_url}
    parts = []
    for lit, ph in template_pieces():
        parts.append(F.lit(lit))
        if ph:
            v = vals[ph]
            parts.append(F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit("")))
    return F.concat(*parts)


def prompt_requests(bundle: DataFrame, id_col: str = "request_id") -> DataFrame:
    """(id, user, n_chars): the user prompt of every request. The system prompt
    is one constant; it is not carried with the rows."""
    return bundle.select(id_col, user_prompt("home_text", "pricing_text", "pricing_url").alias("user")) \
        .withColumn("n_chars", F.length("user"))


def score(requests: DataFrame, client_factory: Callable[[], Callable[[str, str], str]],
          attempts: int = 2, id_col: str = "request_id", system: str = SYSTEM_PROMPT) -> DataFrame:
    """R-13: ``(id, raw_answer, attempts, error)``.

    ``client_factory()`` runs once per partition on the executor and returns
    ``call(system, user) -> raw text``. Only the id and the user prompt are
    shipped to Python.
    """
    schema = T.StructType([requests.schema[id_col], T.StructField("raw_answer", T.StringType()),
                           T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client_factory()
        for b in batches:
            raws, tries, errs = [], [], []
            for u in b["user"]:
                raw, err, n = None, None, 0
                while n < attempts:
                    n += 1
                    try:
                        raw, err = call(system, u), None
                        break
                    except Exception as e:  # noqa: BLE001 - a failed call is reported in its row
                        err = f"{type(e).__name__}: {e}"
                raws.append(raw)
                tries.append(n)
                errs.append(err)
            yield pd.DataFrame({id_col: b[id_col], "raw_answer": raws, "attempts": pd.Series(tries, dtype="int32"),
                                "error": errs})

    return requests.select(id_col, "user").mapInPandas(run, schema)


STUB_REFUSES = 7  # the stand-in fails for prompts whose length is a multiple of this


def stub_client_factory():
    """Deterministic stand-in for the model, for tests and benchmarks: the whole
    prompt's length and number of line breaks in the first and last field. It
    refuses some prompts, so that failed calls occur."""
    import json

    from sitelens.schemas import FIELD_KEYS

    def call(system: str, user: str) -> str:
        if len(user) % STUB_REFUSES == 0:
            raise RuntimeError("refused")
        data = {FIELD_KEYS[0]: f"{len(user)} characters", FIELD_KEYS[-1]: f"{user.count(chr(10))} breaks"}
        return "```json\n" + json.dumps(data, ensure_ascii=False) + "\n```"

    return call
