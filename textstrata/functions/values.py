"""Fixed values that results depend on, as text, in their order of use."""

# Question phrases, removed in this order.
QUESTION_PHRASES = """会被怎么处理 会怎么处理 会被如何 我想知道 麻烦问一下 请问 会被 怎么办 怎么处理 怎么办理 如何处理 怎么算 怎么认定
谁来负责 由谁负责 谁负责 由谁办理 需要什么 有哪些 是什么 属于什么 算不算 可以吗 可不可以 能不能 行不行 会不会 要不要 是否 怎么
如何 哪些 什么""".split()

# Colloquial terms and their formal ones.
FORMAL_TERMS = [
    ("社保", "社会保险"), ("医保", "基本医疗保险"), ("个税", "个人所得税"), ("低保", "最低生活保障"), ("五保", "特困人员供养"),
    ("公积金", "住房公积金"), ("老板", "用人单位"), ("员工", "劳动者"), ("欠薪", "拖欠工资"), ("欠缴", "不缴纳"), ("欠缴", "拖欠"),
    ("工伤", "因工负伤"), ("驾照", "机动车驾驶证"), ("身份证", "居民身份证"), ("注会", "注册会计师"), ("打官司", "诉讼"),
    ("坐牢", "有期徒刑"), ("探矿", "探矿权"), ("采矿", "采矿权"), ("网约车", "网络预约出租汽车"), ("无人机", "民用无人驾驶航空器"),
]

# Words without substance, least substance in characters.
EMPTY_WORDS = "这个 那个 这些 那些 它 它们 事情 东西 问题 情况 啥 什么 咋办".split()
LEAST_SUBSTANCE = 3

# Questions about the asker's own case.
FIRST_PERSONS = "我 本人 自己 咱 我方".split()
JUDGEMENTS = "能否 能不能 可不可以 是否可以 有没有权 有没有资格 该不该 要不要 可以领 能领 可以享受 能享受 可以申请 能申请 算不算 够不够 是否符合 有没有权享受 资格".split()

# Numerals.
DIGITS = "零一二三四五六七八九"
UNITS = [("十", 10), ("百", 100), ("千", 1000)]

# Outline levels from the outermost, and their signs.
LEVELS = ["part", "chapter", "section", "article"]
LEVEL_SIGNS = [("编", "part"), ("章", "chapter"), ("节", "section")]
LONGEST_HEADING = 50
HEADING_STOPS = "，。；！？"
CLAUSE_ENDS = "。！？；："
REFERENCE_TAILS = "、，。；："
LONGEST_CHUNK = 800

# Kinds of instrument by the end of the title, in order; None: a rule of a department, or a regulation if a State organ issued it.
TITLE_ENDS = [
    ("法典", "law"), ("条例", "administrative_regulation"), ("办法", None), ("规定", None), ("细则", None), ("规则", None),
    ("通则", None), ("解释", "judicial_interpretation"), ("法", "law"),
]
STATE_ORGANS = ["国务院", "全国人民代表大会", "全国人民代表大会常务委员会"]
COUNTRY = "中华人民共和国"
UNLABELLED = "未标注版本"
UNKNOWN_TEXT = "未知"
STATUS_ORDER = ["effective", "not_yet_effective", "repealed", "unknown"]
MEDIA_ORDER = ["application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/pdf"]
NOT_RANKED = 9

# Citations.
LOCAL_NAMES = "本法 本条例 本规定 本细则 本实施细则".split()
CITATION_REACH = 60

# Identifiers, their patterns and labels.
IDENTIFIERS = [
    ("id_number", "身份证", r"\d{17}[\dXx]"),
    ("case_number", "案号", r"[（(]\d{4}[）)][一-龥A-Za-z0-9]{1,20}?号"),
    ("phone", "电话", r"(?<!\d)1[3-9]\d{9}(?!\d)"),
]

# States of validity as shown, and those that can't be relied on.
STATUS_LABELS = {"effective": "现行有效", "not_yet_effective": "尚未生效，不得作为现行依据", "repealed": "已被取代", "unknown": "施行日期未知"}
NOT_CURRENT = ["repealed", "not_yet_effective"]

# Claims that leave no exception, and words that make one.
EXHAUSTIVE = "所有 任何 一律 一概 全部 无论 凡是 任何情况 无一例外 均 都".split()
QUALIFIERS = "除 但是 除外 符合规定 另有规定 按照规定 有下列情形 情形之一 限于 经批准 经同意 情况下".split()
DUTY, LEAVE = "应当", "可以"

# Answers that abstain, and that flag validity.
ABSTAINS = "依据不足 无法回答 不能回答 没有检索到 未检索到 缺乏依据 不足以回答".split()
FLAGS = "尚未生效 未生效 尚未施行 不得作为现行依据 已被取代 已失效 已经失效 已废止".split()

# States of an answer and allowed changes.
TRANSITIONS = {
    "CREATED": ["CLARIFYING", "RETRIEVING"],
    "CLARIFYING": ["RETRIEVING", "NEEDS_REVIEW", "FAILED"],
    "RETRIEVING": ["RERANKING", "ASSEMBLING_EVIDENCE", "INSUFFICIENT_EVIDENCE", "NEEDS_REVIEW", "FAILED"],
    "RERANKING": ["ASSEMBLING_EVIDENCE", "FAILED"],
    "ASSEMBLING_EVIDENCE": ["GENERATING", "NEEDS_REVIEW", "FAILED"],
    "GENERATING": ["VERIFYING", "NEEDS_REVIEW", "FAILED"],
    "VERIFYING": ["ANSWERED", "PARTIAL", "NEEDS_REVIEW", "FAILED"],
}

# Permissions of roles.
READS = ["wiki.read", "document.read", "document.download"]
ROLES = {
    "reader": READS,
    "editor": [*READS, "wiki.write", "document.write"],
    "legal_reviewer": [*READS, "review.decide"],
    "knowledge_admin": [*READS, "wiki.write", "wiki.grant", "document.write", "document.grant", "source.manage", "review.decide"],
    "system_admin": ["user.manage"],
    "auditor": ["wiki.read", "document.read", "audit.read"],
}

# Errors of jobs by status, and whether to retry.
JOB_ERRORS = {404: ("document_missing", False), 413: ("document_too_large", False), 422: ("parse_rejected", False), 503: ("document_unavailable", True), 507: ("resource_exhausted", True)}

# Media types of file name ends; elements that are blocks and that are left out.
MEDIA_TYPES = {".docx": MEDIA_ORDER[0], ".pdf": MEDIA_ORDER[1], ".html": "text/html", ".htm": "text/html", ".txt": "text/plain"}
BLOCK_ELEMENTS = "p div li h1 h2 h3 h4 h5 h6 td th dt dd pre blockquote figcaption caption article section aside header footer main nav tr ul ol table body".split()
LEFT_OUT_ELEMENTS = "script style noscript template".split()
