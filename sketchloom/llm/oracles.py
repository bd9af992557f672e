"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_TWO = "('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp', 'com.br', 'com.cn', 'co.in', 'co.za', 'com.mx')"


def _last(host: str, n: int) -> str:
    return f"array_to_string(list_slice(string_split({host}, '.'), -{n}, -1), '.')"


def _strength(level: str) -> str:
    """Share p and strength k of a level's groups (n, good), by moments."""
    return f"""k_{level} AS (SELECT CASE WHEN n IS NULL THEN 0.5 ELSE p END AS p, CASE WHEN n IS NULL OR p IN (0, 1) OR b <= 0 THEN 10.0 ELSE 1 / least(0.5, greatest(1.0 / 1001, (sp - w) / b)) - 1 END AS k
FROM (SELECT n, p, w, b, CASE WHEN p NOT IN (0, 1) THEN (s - n * p * p) / (p * (1 - p)) END AS sp FROM
(SELECT sum(n)::DOUBLE AS n, sum(good)::DOUBLE / sum(n) AS p, count(*) - 1.0 AS w, sum(n) - sum(n * n)::DOUBLE / sum(n) - (count(*) - 1.0) AS b, sum(good * good / n::DOUBLE) AS s FROM {level})))"""


_NAME = "rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.')"
_ADDRESS = "(regexp_full_match(name, '[0-9.]*') OR starts_with(name, '['))"


URL_FILTERS = f"""WITH p AS (SELECT *, {_NAME} AS name FROM (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce({_REST}, '') AS rest FROM pages))),
lab AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END) AS good FROM labels GROUP BY doc_id),
every AS (SELECT name, count(good) AS n, CAST(coalesce(sum(good), 0) AS BIGINT) AS good FROM p LEFT JOIN lab ON doc_id = page_id GROUP BY name),
named AS (SELECT *, CASE WHEN {_ADDRESS} THEN name WHEN {_last('name', 2)} IN {_TWO} THEN {_last('name', 3)} ELSE {_last('name', 2)} END AS domain,
CASE WHEN {_ADDRESS} THEN '' WHEN {_last('name', 2)} IN {_TWO} THEN {_last('name', 2)} ELSE {_last('name', 1)} END AS suffix FROM every),
hosts AS (SELECT * FROM named WHERE n > 0),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL), suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL),
{_strength('hosts')}, {_strength('domains')}, {_strength('suffixes')},
suffix_means AS (SELECT suffix, (good + p * k) / (n + k) AS m FROM suffixes, k_suffixes), domain_means AS (SELECT domain, (good + m * k) / (n + k) AS m FROM domains JOIN suffix_means USING (suffix), k_domains),
posterior AS (SELECT name, n, good, (good + coalesce(d.m, s.m, a.p) * k) / (n + k) AS mean, n + k AS size FROM named LEFT JOIN domain_means d USING (domain) LEFT JOIN suffix_means s USING (suffix), k_hosts, (SELECT p FROM k_suffixes) a),
judged AS (SELECT p.page_id, p.host, p.path, n, good, mean + 1.645 * sqrt(mean * (1 - mean) / (size + 1)) < 0.5 AS bad FROM p JOIN posterior q ON q.name = p.name),
ruled AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM judged)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR bad THEN 'block' ELSE 'allow' END AS verdict, n AS outcomes, good FROM ruled"""

_LETTERS = ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {1 + 5 * (k // 4)}, 5) AS BIGINT) >> {15 - 5 * (k % 4)}) & 31) + 1, 1)" for k in range(32))
WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages), g AS (SELECT h AS of, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, concat({_LETTERS}) AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p JOIN g ON of = h"""

ORACLE_SQL = {"op8_warc": WARC, "op10_url_filters": URL_FILTERS}
