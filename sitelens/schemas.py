"""The answer record, the report row and the outbox schema: one definition.

The 24 answer fields are a fixed contract: their order is the report column
order and their JSON keys are the ones the model is asked to fill in.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the audited application's contract).
# Answer fields in report order, as (column name, JSON key of the answer).
ANSWER_FIELDS: list[tuple[str, str]] = [
    ("offer_first_screen", "Оффер (первый экран)"),
    ("cta_first_screen", "CTA (первый экран)"),
    ("utp_formula", "УТП (по формуле)"),
    ("product_services", "Продукт / услуги (кратко)"),
    ("education_program", "Программа обучения"),
    ("all_cta", "Все CTA (текст + контекст)"),
    ("benefits", "Выгоды"),
    ("target_audience_pains", "Боли ЦА"),
    ("prices_tariffs", "Цены и тарифы (с источником)"),
    ("installment_payment", "Рассрочка / Оплата позже"),
    ("promotions", "Акции (условия/сроки)"),
    ("bonuses_gifts", "Бонусы / Подарки"),
    ("guarantees", "Гарантии"),
    ("trust_factors", "Факторы доверия"),
    ("lead_magnets", "Лид-магниты / Квизы"),
    ("contacts_social", "Контакты и соцсети"),
    ("online_chat", "Онлайн-чат (наличие/тип/расположение)"),
    ("application_forms", "Формы заявки (поля/кнопки)"),
    ("main_structure", "Структура главной (сверху вниз)"),
    ("faq", "FAQ (10–15 ключевых)"),
    ("marketing_insights", "Маркетинговые выводы"),
    ("growth_hypotheses", "Гипотезы роста (SMART)"),
    ("brief_summary", "Краткая сводка (3–4 пункта)"),
    ("notes", "Заметки (служебно)"),
]
# Display headers of the four metadata columns of a report row.
META_HEADERS = ["Дата и время анализа", "ID пользователя", "Ссылка", "Страница с ценами"]
# Prefix of the error cell written when a stored result cannot be converted.
ERROR_CELL_PREFIX = "Ошибка обработки: "
# Destination link prefix and the default destination id when none is set.
SHEET_URL_PREFIX = "https://docs.google.com/spreadsheets/d/"
# Default per-user audit quota.
DEFAULT_USER_LIMIT = 10
# ---------------------------------------------------------------------------

FIELDS: list[str] = [c for c, _ in ANSWER_FIELDS]
FIELD_KEYS: list[str] = [k for _, k in ANSWER_FIELDS]
META_COLUMNS = ["timestamp", "user_id", "analyzed_url", "pricing_url"]
REPORT_COLUMNS: list[str] = META_COLUMNS + FIELDS
REPORT_HEADERS: list[str] = META_HEADERS + FIELD_KEYS

assert len(FIELDS) == 24 and len(REPORT_COLUMNS) == 28

OUTBOX = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("result_json", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("written", T.BooleanType(), False),
])

SETTINGS = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("sheet_id", T.StringType(), True),
])

LIMITS = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("current", T.LongType(), False),
    T.StructField("max_limit", T.LongType(), True),
])
