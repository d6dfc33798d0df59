"""DuckDB twins of the registered queries (the correctness oracle).

Same column names as the Spark queries. Built from ``sitelens.plans.sqlgen``
fragments; the tables are the driver's pre-registered views.
"""

from __future__ import annotations

from sitelens.plans import sqlgen as S
from sitelens.plans import standin as Si


def _pages_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    st = S.Stages("SELECT page_id, url FROM pages")
    o["url_normalize"] = str(S.normalize_url(st, "url", "norm_url").select("page_id, url, norm_url"))
    st = S.Stages("SELECT page_id, url FROM pages")
    o["url_valid"] = str(S.valid_url(st, "url", "is_valid").select("page_id, is_valid"))
    st = S.Stages("SELECT page_id, url FROM pages")
    dom = str(S.domain(st, "url", "domain").select("page_id, domain"))
    o["url_domain"] = dom
    o["domain_page_counts"] = f"SELECT domain, count(*) AS n_pages FROM ({dom}) GROUP BY domain"
    o["html_to_text"] = f"SELECT page_id, {S.marked_text(Si.HARD_MARKUP, S.raw_text('html'))} AS text FROM pages"
    st = S.Stages("SELECT page_id, url, html FROM pages")
    dom2 = str(S.domain(st, "url", "domain"))
    n = f"length({S.html_to_text('html')})"
    o["page_length_stats"] = (f"SELECT domain, count(*) AS n_pages, min({n})::BIGINT AS min_chars, "
                              f"max({n})::BIGINT AS max_chars, sum({n})::BIGINT AS sum_chars FROM ({dom2}) GROUP BY domain")
    o["html_strip_tags"] = f"SELECT page_id, {S.strip_tags('html')} AS text FROM pages"
    n = f"length({S.strip_ws('text')})"
    o["page_js_flag"] = (f"SELECT page_id, length(text) AS n_chars, NOT ({n} < 50) AS home_ok, "
                         f"(CASE WHEN {n} < 50 THEN true ELSE {n} < 500 END) AS requires_js "
                         f"FROM (SELECT page_id, {S.html_to_text('html')} AS text FROM ({S.site_pages()}))")
    o["page_excerpt"] = (f"SELECT page_id, substr(html, 1, 10000) AS html_excerpt, "
                         f"substr({S.html_to_text('html')}, 1, 8000) AS text_excerpt FROM pages")
    o["html_visible_text"] = (f"SELECT page_id, {S.marked_text(Si.HIDDEN_MARKUP, S.raw_text('html', True))} AS visible_text "
                              f"FROM pages")
    o["page_links"] = S.page_links("SELECT page_id, html FROM pages")
    st = S.Stages("SELECT page_id, url, html FROM pages")
    S.normalize_url(st, "url", "norm_url")
    links = S.Stages(S.page_links(str(st), keep=["norm_url"]))
    o["url_join"] = str(S.url_join(links, "norm_url", "href", "abs_url").select("page_id, pos, href, abs_url"))
    st = S.Stages(S.site_pages())
    S.normalize_url(st, "url", "norm_url")
    st = S.pricing_link(st, "html", "norm_url", "pricing_link")
    o["pricing_link"] = str(st.select("page_id, norm_url, pricing_link"))
    o["content_bundle"] = S.crawl_snapshot() + str(S.content_bundle(S.typed_requests()).select(
        "request_id, norm_url, fetched, home_text, requires_js, pricing_url, pricing_text"))
    o["bundle_stream"] = o["content_bundle"]
    return o


def _texts_sql() -> dict[str, str]:
    from sitelens.plans.texts import NOISE_LINES
    o: dict[str, str] = {}
    o["text_clean"] = f"SELECT doc_id, {S.clean_text('text')} AS text_out FROM documents"
    lines = "[" + ", ".join(S.q(x) for x in NOISE_LINES) + "]"
    noisy = f"SELECT doc_id, text || {lines}[(doc_id % {len(NOISE_LINES)}) + 1] AS text FROM documents"
    step1 = f"SELECT doc_id, {S.nav_patterns('text')} AS t1 FROM ({noisy})"
    o["nav_noise"] = S.drop_frequent_words(step1, "t1")
    o["frequent_words"] = S.frequent_words("SELECT doc_id, text FROM documents")
    o["drop_frequent_words"] = S.drop_frequent_words("SELECT doc_id, text FROM documents")
    return o


def _answers_sql() -> dict[str, str]:
    from sitelens.operators.scoring import STUB_REFUSES, SYSTEM_PROMPT, template_pieces
    from sitelens.plans.answers import PRICED_URL
    from sitelens.schemas import FIELDS
    o: dict[str, str] = {}
    o["json_unwrap"] = f"SELECT doc_id, {S.json_unwrap('raw')} AS json_text FROM ({S.synthetic_answers()})"
    parsed = S.parsed_answers()
    o["answer_fields"] = f"SELECT doc_id, parse_ok, {', '.join(FIELDS)} FROM ({parsed})"
    summ = f"(CASE WHEN parse_ok THEN {S.short_summary()} END)"
    o["summary_points"] = (f"SELECT doc_id, len(pts)::BIGINT AS n_points, to_json(pts)::VARCHAR AS points "
                           f"FROM (SELECT doc_id, {summ} AS pts FROM ({parsed}))")
    q = S.Stages(parsed).add("short_summary", S.short_summary()).add("requires_js", "n_chars < 500") \
        .add("pricing_url", f"CASE WHEN doc_id % 2 = 0 THEN {S.q(PRICED_URL)} END")
    flags = S.quality_flags()
    aggs = ["count(*) AS n_answers", "count_if(parse_ok) AS n_parsed"]
    aggs += [f"count_if(parse_ok AND NOT {f}) AS n_fail_{k[:-3]}" for k, f in flags.items()]
    o["answer_quality"] = f"SELECT {', '.join(aggs)} FROM ({q})"
    b = S.content_bundle(S.typed_requests()).where("fetched AND home_text <> ''")
    user = " || ".join(S.q(lit) + (f" || coalesce({ph[1:-1].lower()}, '')" if ph else "")
                       for lit, ph in template_pieces())
    prompts = f"SELECT request_id, {user} AS u FROM ({b})"
    o["prompt_requests"] = (f"{S.crawl_snapshot()} SELECT request_id, (length({S.q(SYSTEM_PROMPT)}) + length(u))::BIGINT "
                            f"AS n_chars, sha256(u) AS user_sha FROM ({prompts})")
    failed = f"length(u) % {STUB_REFUSES} = 0"
    o["batch_score"] = (
        f"{S.crawl_snapshot()} SELECT request_id, CASE WHEN {failed} THEN 2 ELSE 1 END::BIGINT AS attempts, "
        f"CASE WHEN {failed} THEN 'RuntimeError: refused' END AS error, NOT ({failed}) AS parse_ok, "
        f"CASE WHEN NOT ({failed}) THEN length(u) || ' characters' END AS offer_first_screen, "
        f"CASE WHEN NOT ({failed}) THEN (len(string_split(u, chr(10))) - 1) || ' breaks' END AS notes FROM ({prompts})")
    return o


def _events_sql() -> dict[str, str]:
    from sitelens.schemas import DEFAULT_USER_LIMIT as D
    o: dict[str, str] = {}
    links = S.sheet_links()
    o["sheet_id_extract"] = f"SELECT event_id, link, sheet_id FROM ({links})"
    o["settings_latest"] = (f"SELECT user_id, arg_max(sheet_id, (ts, event_id)) AS sheet_id FROM ({links}) "
                            f"WHERE sheet_id <> '' GROUP BY user_id")
    from sitelens.plans.events import CONNECTED_USER
    o["destination_for_user"] = f"SELECT * FROM ({o['settings_latest']}) WHERE user_id = {S.q(CONNECTED_USER)}"
    o["admin_changes"] = f"SELECT event_id, actor, {S.is_admin('actor')} AS is_admin FROM ({S.limit_commands()})"
    o["limit_changes_valid"] = S.limit_changes()
    req = S.audit_requests()
    o["limits_initial"] = (f"SELECT user_id, 0::BIGINT AS current, arg_min(max_limit, (ts, event_id)) AS max_limit FROM ("
                           f"SELECT user_id, ts, request_id AS event_id, {D}::BIGINT AS max_limit FROM ({req}) "
                           f"UNION ALL SELECT user_id, ts, event_id, max_limit FROM ({S.limit_changes()})) GROUP BY user_id")
    adm = (f"SELECT request_id, user_id, would_succeed, coalesce(sum(CAST(would_succeed AS BIGINT)) OVER "
           f"(PARTITION BY user_id ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT "
           f"AS prior_ok FROM ({req})")
    adm = f"SELECT *, prior_ok < {D} AS admitted FROM ({adm})"
    o["quota_admission"] = f"SELECT request_id, user_id, prior_ok, admitted FROM ({adm})"
    tl = S.timeline()
    o["limit_asof"] = (f"SELECT request_id, user_id, coalesce(lim, {D})::BIGINT AS max_limit FROM ("
                       f"SELECT *, last(new_limit IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, request_id "
                       f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lim FROM ({tl})) WHERE new_limit IS NULL")
    walk = f"WITH RECURSIVE {S.replay(tl)} "
    o["quota_replay"] = walk + "SELECT request_id, user_id, admitted, lim AS max_limit FROM walk WHERE NOT is_change"
    o["limits_final"] = walk + ("SELECT user_id, arg_max(used, k) AS current, arg_max(lim, k) AS max_limit FROM walk "
                                "GROUP BY user_id")
    o["usage_counts"] = walk + "SELECT user_id, max(used) AS current FROM walk GROUP BY user_id"
    from sitelens.operators import dialog as Dg
    w = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ws = "OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    base = (f"SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type AS kind, "
            f"CASE WHEN event_type IN ('{Dg.START_BUTTON}', '{Dg.CONNECT_BUTTON}') THEN event_type END AS button FROM events")
    sess = (f"SELECT *, sum(CASE WHEN button IS NOT NULL THEN 1 ELSE 0 END) {w} AS session, "
            f"last(button IGNORE NULLS) {w} AS state FROM ({base})")
    texts = (f"SELECT *, coalesce(count(*) {ws}, 0) AS prior_texts, "
             f"coalesce(sum(CASE WHEN kind = '{Dg.TEXT_WITH_ID}' THEN 1 ELSE 0 END) {ws}, 0) AS prior_valid "
             f"FROM ({sess}) WHERE kind IN ('{Dg.TEXT_PLAIN}', '{Dg.TEXT_WITH_ID}')")
    action = (f"CASE WHEN session = 0 THEN 'ignored' WHEN state = '{Dg.START_BUTTON}' THEN "
              f"(CASE WHEN prior_texts = 0 THEN 'audit' ELSE 'ignored' END) WHEN state = '{Dg.CONNECT_BUTTON}' THEN "
              f"(CASE WHEN prior_valid > 0 THEN 'ignored' WHEN kind = '{Dg.TEXT_WITH_ID}' THEN 'sheet_connected' "
              f"ELSE 'sheet_invalid' END) ELSE 'ignored' END")
    from sitelens.plans.events import DEFAULT_SHEET_ID
    from sitelens.schemas import SHEET_URL_PREFIX
    o["sheet_urls"] = (f"SELECT u.user_id, {S.q(SHEET_URL_PREFIX)} || coalesce(nullif(l.sheet_id, ''), "
                       f"{S.q(DEFAULT_SHEET_ID)}) AS url FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id "
                       f"FROM events) u LEFT JOIN ({o['settings_latest']}) l ON u.user_id = l.user_id")
    o["message_routing"] = f"SELECT event_id, user_id, session::BIGINT AS session, {action} AS action FROM ({texts})"
    # The streaming versions must equal the batch closed forms.
    o["quota_stream"] = o["quota_replay"]
    o["dialog_stream"] = o["message_routing"]
    return o


def _audit_sql() -> dict[str, str]:
    from sitelens.plans.events import PROBE_USER
    from sitelens.schemas import REPORT_COLUMNS, REPORT_HEADERS
    o: dict[str, str] = {}
    audit, pend = S.audit(), S.pending_rows()
    o["audit_outcome"] = (
        f"{audit} SELECT request_id, user_id, reason = 'ok' AS ok, CASE WHEN reason <> 'ok' THEN reason END AS reason, "
        f"CASE WHEN reason = 'ok' THEN to_json({S.short_summary()})::VARCHAR END AS short_summary, "
        f"CASE WHEN reason = 'ok' THEN sheet_id IS NOT NULL END AS written_now, error "
        f"FROM decided d LEFT JOIN answers a ON a.doc_id = d.doc_id")
    o["result_envelope"] = f"{audit} SELECT request_id, result_json FROM results"
    o["outbox_route"] = (f"{audit} SELECT request_id, user_id, CASE WHEN sheet_id IS NULL THEN 'pending' ELSE 'write' END "
                         f"AS route, sheet_id FROM decided WHERE reason = 'ok'")
    o["pending_results"] = f"{audit} SELECT row_id, id, row_key, user_id, url, created_at, written FROM ({pend})"
    o["outbox_append"] = (f"{audit} SELECT row_number() OVER (ORDER BY created_at, id) AS row_id, id, user_id, url, created_at "
                          f"FROM ({pend})")
    o["outbox_flush"] = f"{audit} SELECT id, user_id, flush_event_id, flushed_to FROM ({pend}) WHERE written"
    o["outbox_unwritten"] = f"{audit} SELECT id, user_id, url, created_at FROM ({pend}) WHERE NOT written"
    from sitelens.plans.audit import ROUNDS
    rounds = " ".join(f"WHEN flushed_at <= TIMESTAMP '{t}' THEN {n}" for n, t in enumerate(ROUNDS))
    o["outbox_delivery"] = (f"{audit} SELECT id, CASE {rounds} END::BIGINT AS round FROM ({pend}) "
                            f"WHERE flushed_at <= TIMESTAMP '{ROUNDS[-1]}'")
    o["flush_counts"] = (f"{audit} SELECT l.event_id, l.user_id, coalesce(n.n, 0)::BIGINT AS n_flushed FROM "
                         f"({S.sheet_links()}) l LEFT JOIN (SELECT flush_event_id, count(*) AS n FROM ({pend}) "
                         f"WHERE written GROUP BY flush_event_id) n ON n.flush_event_id = l.event_id "
                         f"WHERE l.sheet_id <> ''")
    o["report_rows"] = f"{audit} {S.report_row(S.deliveries())}"
    o["report_rows_stamped"] = f"{audit} {S.report_row(S.deliveries(), stamped=True)}"
    # the first row of each destination: the 28 headers, none, other ones, or no row at all
    heads = "[" + ", ".join(S.q(h) for h in REPORT_HEADERS) + "]"
    sheets = f"SELECT DISTINCT sheet_id, {S.crc32('sheet_id')} % 4 AS c FROM ({S.deliveries()})"
    header = f"CASE WHEN first_row IS NULL OR len(first_row) = 0 THEN 'create' WHEN first_row = {heads} THEN 'ok' ELSE 'mismatch' END"
    checked = (f"SELECT sheet_id, {header} AS header FROM (SELECT sheet_id, CASE c WHEN 0 THEN {heads} WHEN 1 THEN []::VARCHAR[] "
               f"WHEN 2 THEN ['Дата', 'Сайт'] END AS first_row FROM ({sheets}))")
    o["sink_header_check"] = f"{audit} {checked}"
    o["written_reports"] = (f"{audit} SELECT r.sheet_id, header, {', '.join('r.' + c for c in REPORT_COLUMNS)} "
                            f"FROM ({S.report_row(S.deliveries())}) r JOIN ({checked}) c ON c.sheet_id = r.sheet_id")
    o["delivered_reports"] = f"{audit} SELECT request_id, sheet_id, row_ok FROM ({S.report_row(S.deliveries())})"
    o["pending_for_user"] = (f"{audit} SELECT id, user_id, url, created_at FROM ({pend}) WHERE user_id = {S.q(PROBE_USER)} "
                             f"ORDER BY created_at, id")
    return o


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(_pages_sql())
    out.update(_texts_sql())
    out.update(_answers_sql())
    out.update(_events_sql())
    out.update(_audit_sql())
    return out
