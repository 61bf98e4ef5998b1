"""Fixed values that results depend on."""

# English words that carry no feature.
ENGLISH_STOP = """
a an the and or but if then than to of in on at for from with without by as is are was were be been being it this that
these those i you we they he she my your our their do does did have has had can could would should will just what which
who where when how why about into through very more
""".split()
# Chinese words that carry no feature, single characters that do, and characters no gram may start or end with.
CHINESE_STOP = """
这个 那个 我们 你们 他们 可以 就是 一个 一些 已经 现在 然后 因为 所以 但是 还是 可能 什么 怎么 这样 那样 一下 一下子 觉得 有没有 是不是
会不会 能不能 为什么 的话 里面 本身 真的 其实 来说
""".split()
CHINESE_KEY = "叫改快慢小准禁存取读写查压解引奖会费名"
CHINESE_EDGE = "的一是在了和与或而也就都还把被给从到让要会能可用这那我你他她它们个些其于为之并及所吗呢么"
# Query cues and the terms that each adds.
EXPANSIONS = [
    ("叫什么 名字 名称 项目名 name", "叫|命名|决定|暂定|全称|暂定全称|called"),
    ("核心概念 主要概念 concept", "概念|提出|定义|命名|framework|operation"),
    ("核心目标 主要目标 purpose goal", "核心|目标|目的|定位"),
    ("保留 保存 丢失 preserve", "完整|无损|原文|历史|完整对话|lossless"),
    ("完整历史 全部历史 每次都发 全量上下文", "活跃上下文|固定预算|只取|相关内容|按需"),
    ("写入 追加 边聊 进行时", "持续写入|每轮|追加|continuous|append"),
    ("读取 怎么读 如何读 read", "reader|skill|decode|query|检索"),
    ("引用 被引 citation cited", "reference|related work|google scholar"),
    ("演讲 报告 presentation talk", "分钟|发言|oral"),
    ("修正 改正 后来 重新理解 纠正", "实际上|不需要|不需要这么快|理解偏|不是|改为|重新"),
    ("下一步 接下来 继续 目前", "测试|压测|实验|benchmark|next step|当前任务"),
    ("进行时 边聊 持续写入 怎么写入 如何写入 append", "每轮|持续|追加|边聊边写|写入"),
    ("先后 顺序 先做 后做", "先|然后|产品|论文|再写"),
    ("完整历史 每次都发 为什么不 全部历史", "相关|按需|预算|活跃上下文|固定"),
    ("保留什么 完整原始 原始历史", "完整|原始|无损|历史|原文"),
    ("原则 快小精准 三原则", "快|小|精准|原则"),
]
# What raises a sentence in an excerpt: cues of the query (none: any query), pattern of the sentence, bonus.
EXCERPT_BONUSES = [
    ("", r"核心|决定|意味着|指|定义|提出|是:|is |means|propose", 0.05),
    ("分钟|多久|多长时间|duration|how long", r"\d+\s*[–-]\s*\d+\s*分钟|\d+\s*分钟", 1.75),
    ("引用|被引|citation|cited", "被引用|引用了|1 次|1次|一引|related work|reference", 1.10),
    ("核心概念|概念是什么|concept", "dual recognition|third resistance|richer existential geometry|multidimensional positionality", 1.20),
    ("怎么回复|如何回复|reply", "dear |confirm|确认参加|with best regards", 1.25),
]
# Feature weights in tenths.
LATIN_LONG, LATIN_SHORT, LATIN_MARKED, CJK_SINGLE, CJK_PHRASE, CJK_KEY = 58, 34, 14, 34, 42, 18
CJK_GRAMS = {2: 40, 3: 34, 4: 28}
# What a Latin token is, and what is stripped from its ends.
LATIN = r"[A-Za-z0-9_][A-Za-z0-9_./:+#@-]*"
LATIN_EDGE = "./:+#@-"

# Entry kinds with their priority among a turn's atoms, retrieval boost and latest-state weight and cap.
KIND_PRIORITY = {"DECISION": 8, "REQUIREMENT": 7, "WARNING": 6, "TASK": 5, "PREFERENCE": 4, "FACT": 3, "TRACE": 2, "ARTIFACT": 1}
KIND_BOOST = {"DECISION": 1.38, "REQUIREMENT": 1.34, "WARNING": 1.30, "TASK": 1.18, "PREFERENCE": 1.16, "FACT": 1.06}
STATE_WEIGHT = {"TASK": 1.35, "DECISION": 1.30, "REQUIREMENT": 1.25, "WARNING": 1.20, "PREFERENCE": 1.08, "ARTIFACT": 1.03, "FACT": 1.00, "TRACE": 0.90}
STATE_CAP = {"DECISION": 3, "REQUIREMENT": 3, "TASK": 3}
AUTHORITY = {"user": 1.0, "system": 0.95, "assistant": 0.72, "tool": 0.55}
ROLES = {"human": "user", "user": "user", "assistant": "assistant", "ai": "assistant", "chatgpt": "assistant", "claude": "assistant", "system": "system", "tool": "tool"}

# Cues of the classifiers, tested in this order.
USER_CUES = [
    ("DECISION", 0.96, "定了|决定|确定|最终|就叫|我要叫|项目叫|名字是|名称是|命名为|叫做|we decided|the decision is|we will call|will be called"),
    ("REQUIREMENT", 0.93, "必须|最主要|核心是|核心不是|原则|要让|我们要|我要让|肯定是要|需要做到|要求|目标是|本质是|关键是|must|need to|we need|requirement|the core is|should support|has to"),
    ("WARNING", 0.92, "不要|别把|别再|避免|不应该|不得|不需要|不能把|do not|don't|avoid|must not|should not|not a generic"),
    ("TASK", 0.89, "下一步|接下来|开始准备|开始做|现在做|继续开发|继续实现|继续吧|开始创造|todo|next step|start building|implement|current task"),
    ("PREFERENCE", 0.86, "我想|我希望|我觉得|我不要|我更想|我在想|偏好|i want|i prefer|i don't want|i do not want|i would like"),
]
OTHER_CUES = [
    ("DECISION", 0.86, "定了:|定了：|最终决定|项目叫|我们决定|the decision is"),
    ("REQUIREMENT", 0.82, "真正要做的|核心不是|核心是|准确定位|必须|产品原则|目标是|the core is|must|the goal is"),
    ("WARNING", 0.80, "不要把|不能把|不应该|do not|must not"),
    ("TASK", 0.78, "下一步|接下来应该|第一版先|现在需要|next step"),
    ("TRACE", 0.70, "建议|可以考虑|可以先|更合理|一种方式|we propose|we can"),
]
QUESTION_CUES = "为什么|怎么|谁|有没有|会不会|能不能|是不是"
DEFINITION_CUES = "是一个|是指|指的是|意味着|包括|名为|题目|文章|论文|引用|任教|主席|研究方向|认证|定位|called|means|is a|refers to|introduces|proposes|consists of"
UNIT_CUES = "分钟|小时|天|年|届|页|词|学生|排名|citation|cited"
ANSWER_CUES = "怎么|如何|回复|是什么|为什么|what|why|how|reply"
