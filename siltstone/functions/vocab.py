"""Controlled vocabularies, bounds and thresholds in one place. All of them are fixed values."""

from __future__ import annotations

SNAPSHOT_START, SNAPSHOT_END = "2012-01-01", "2026-08-07"
FAMILIES = ("KPL", "PASAXON")  # families of source codes, by prefix

GRADES = ("A1", "A2", "B1", "B2", "C1", "C2")
FORMAL_GRADES = ("A1", "A2", "B1", "B2")
GRADE_SCORES = {"A1": 35, "B1": 32, "A2": 25, "B2": 22, "C1": 8, "C2": -100}
OTHER_GRADE_SCORE = -50
TIERS = ("T1_DIRECT_CHINA", "T2_BILATERAL_VARIANT", "T3_ENTITY_TOPIC", "T4_ARCHIVE_DISCOVERY")
SYNDICATED = ("xinhua", "cri", "syndicated", "reprint")
LOCAL = ("local_original", "local_adapted")
BILATERAL_LABELS = ("bilateral", "china_in_laos")
BILATERAL_SCOPE = "中老"

TARGET, MINIMUM = 4, 2
GAP_REASONS = (
    "no_discovered_records; historical_backfill_required",
    "records_found_but_no_quota_eligible_evidence",
    "eligible_records_found_but_no_verified_body",
    "fewer_than_minimum_qualified_body_stories",
    "fewer_than_target_eligible_unique_stories",
    "",
)
HISTORICAL_BEFORE = "2021-01"
HISTORICAL_ENTRIES = "old_domain|Common_Crawl|LOC_catalog|epaper_PDF|official_reprint"
CURRENT_ENTRIES = "current_search|tag|epaper|30_day_lookback"

TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "fbclid", "gclid")

LAO_TOKENS = (("ຈີນ", "ຈີນ"), ("ສປຈີນ", "ສປ ຈີນ"), ("ລາວຈີນ", "ລາວ-ຈີນ"), ("ຈີນລາວ", "ຈີນ-ລາວ"))
SCREEN_TERMS = ("china", "chinese", "lao-china", "china-laos", "yunnan", "beijing", "guangxi", "kunming", "people's republic of china", "pr china", "xi jinping", "hu jintao", "wen jiabao")
UNION_TERMS = ("china", "chinese", "lao-china", "china-laos", "laos-china", "xi jinping", "beijing", "yunnan", "guangxi", "kunming")
CONTEXT_TERMS = ("china", "chinese", "lao-china", "china-laos", "yunnan", "beijing")
MASKED = ("indochina", "indo-china", "indo china", "ອິນໂດຈີນ", "ອິນໂດ-ຈີນ", "ອິນໂດ ຈີນ", "ອິນດູຈີນ", "ອິນດູ-ຈີນ", "ອິນດູ ຈີນ")
LAO_MASK = r"ອິນ[\s​-]*(?:ດູ|ໂດ)[\s​-]*ຈີນ"
LAO_CONTEXT = ("ປະເທດ", "ລັດຖະບານ", "ທູດ", "ນັກທຸລະກິດ", "ບໍລິສັດ", "ພັກ", "ສະພາ", "ລາວ")
CONTEXT_REACH = 35
DIRECT_QUERIES = ("ສປ ຈີນ", "ສປຈີນ", "ຈີນ", "ລາວ-ຈີນ", "ຈີນ-ລາວ", "China", "Chinese", "Lao-China", "Laos-China", "China-Laos")
TIER2_TERMS = ("ລາວ-ຈີນ", "ຈີນ-ລາວ", "lao-china", "laos-china", "china-laos")
TIER1_TERMS = ("ຈີນ", "china", "chinese")

TEMPLATE_MARK, SPAM_MARKS, LEAST_SPAM = "toggle navigation", ("agen togel", "daftar sbobet", "bertaruh online", "lapak online"), 2
CHALLENGE_MARKS = ("captcha", "verify you are human", "cf-challenge", "access denied")

SECTION_PRIORITY = {"cooperation": 0, "leader": 1, "investment": 2, "economic": 3, "forigner": 4, "politic": 5, "politic1": 5, "pasaxon": 6}
OTHER_SECTION = 20
ID_WINDOWS = ((253, 594, "2020-01"), (1810, 2040, "2020-08"), (2041, 2250, "2020-09"))
INDEX_QUOTAS = {2014: 2, 2015: 2, 2016: 2, 2017: 1, 2018: 1, 2019: 1}
BODY_LEAST = {"old_kpl": 80, "direct": 60, "php_clean": 120, "epaper": 500, "current": 100}
POPULAR_NEWS = "ຂ່າວທີ່ໄດ້ຮັບຄວາມນິຍົມ"
KEPT_LATIN = ("CRI", "GDP", "UNICEF", "Jiang", "Zaidong", "Beate", "Das", "tel")
LEDGER_TERMINAL = ("china_match", "china_match_non_gap", "not_china", "contaminated_template", "duplicate_match", "existing_record", "parse_failure", "http_error", "date_out_of_scope")
