"""Fields of job advertisements as column expressions: degree, years, direction, bullets, and the same for English ones.

Null counts as the empty text. Words and patterns are fixed values, each table under its own name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.text import lines, strip, text_or_empty
from curatrix.operators.matching import argmax
from curatrix.operators.pairing import squeezed

#: Degrees as they are asked for; the first in the text counts, and of two there the first listed.
DEGREE = (
    r"博士(?:研究生)?(?:及以上)?(?:\s*(?:学历|学位))?\s*(?:优先)?",
    r"硕士(?:研究生)?(?:及以上)?(?:\s*(?:学历|学位))?\s*(?:优先)?",
    r"研究生\s*(?:及以上|以上)?\s*学历(?:优先)?",
    r"专科\s*(?:及以上|以上)?\s*学历(?:优先)?",
    r"学士(?:及学士以上|及以上|以上)?(?:的)?(?:学历|学位)(?:优先)?",
    r"本科(?:及以上)?",
    r"大专(?:及以上)?",
    r"全日制本科(?:及以上)?",
    r"统招本科(?:及以上)?",
)
#: Years as they are asked for, in the order in which they are tried.
_N = "[一二三四五六七八九十两0-9]+"
YEARS = (
    r"经验要求[：:]\s*[^，。；;\n]+",
    r"工作经验[：:]\s*[^，。；;\n]+",
    r"经验不限",
    r"工作经验不限",
    rf"{_N}\s*[-~～至]\s*{_N}\s*年(?:工作)?经验",
    rf"{_N}\s*[-~～至]\s*{_N}\s*年",
    rf"(?:至少|不少于|不低于|具备|拥有|具有|需要)?\s*{_N}\s*年\s*(?:以上|及以上|或以上|\+|左右|以内|以下)?(?:的)?[^，。；;\n]{{0,50}}(?:经验|经历|背景)",
    rf"(?:工作经验|相关经验|经验要求|工作年限)[^，。；;\n]{{0,20}}{_N}\s*(?:[-~至～]\s*{_N}\s*)?年",
)
#: A number of years above this is a date.
MOST_YEARS = 50
#: Keys of an advert's other data that tell years, and what asks for none.
YEARS_KEYS = ("experience_requirement", "experience", "work_year", "workYear", "workExperience", "experienceRange")
NO_YEARS, ANY_YEARS = ("不限", "经验不限", "工作经验不限"), "经验不限"

#: Directions by patterns of titles that decide at once, in order.
TITLE_PATTERNS = {
    "前端开发": r"前端开发|web前端|前端工程师|react开发|vue开发|node开发",
    "客户端开发": r"客户端开发|ios开发|android开发|安卓开发|app开发|移动端开发|unity(?:3d)?开发|u3d开发|ue开发|\bue[45]\b.*(?:客户端|gameplay|引擎|渲染|图形|战斗|玩法)|cocos|桌面端开发工程师|音视频引擎sdk开发工程师|腾讯会议-(?:ios|android)研发工程师|软件开发工程师\s*\(sdk\)",
    "嵌入式开发": r"嵌入式|固件|驱动开发|\bbsp\b",
    "硬件研发": r"硬件开发工程师|硬件研发|功率硬件工程师|电力电子硬件开发工程师|系统集成工程师|结构设计工程师|硬件结构设计|音响开发工程师|\bnpi工程师\b|电子电器",
    "网络与基础设施": r"网络规划|网络开发|网络工程师|网络交付|基础架构工程师|数据中心网络|交换机软件研发工程师|云网络高级开发工程师|网络运营工程师|云接入网络运营工程师",
    "AI Infra": r"ai infra|ai infrastructure|机器学习平台|训练平台|推理平台|训推平台|rl infra",
    "高性能计算": r"高性能计算|\bhpc\b|ai编译优化工程师|编程语言&编译器工程师",
    "汽车软件/智驾研发": r"智驾系统架构工程师|驾驶辅助开发工程师|智能行车系统开发工程师|智驾泊车功能开发工程师|底盘集成控制系统开发|底盘电控功能开发工程师|感知质量开发工程师|转向电控工程师|制动电控工程师|发动机软件及标定工程师|混动系统开发工程师|混动电驱控制器工程师",
    "运维开发": r"\bsre\b|运维开发|devops|平台运维|\bidc\b|网络交付工程师|网络工程师|运营运维工程师|秒送物流sre|运营开发工程师|运营开发高级工程师",
    "安全工程": r"安全工程师|渗透测试|漏洞研究|安全研发|攻防|安全运营工程师|安全运营专家|安全运营岗|大模型安全运营",
    "测试开发": r"测试开发|测试工程师|测试负责人|\bqa\b|开发质量工程师（软件）",
    "后端开发": r"后台开发|后端开发|服务端|后台工程师|\bjava(?:web)?(?:软件)?开发(?:工程师|实习生)?|^java(?:工程师)?(?:\s|（|\(|$)|研发岗|资深架构师岗|软件架构开发工程|服务器开发工程师|服务器高级工程师|游戏服务器工程师|游戏玩法开发专家|操作系统高级研发工程师|linux内核高级研发工程师|云存储高级研发工程师",
    "数据开发": r"大数据开发工程师|数据开发工程师",
    "算法工程": r"algorithm engineer|\bnlp\b|\btts\b|\basr\b|对齐策略研发工程师|自然语言处理|游戏ai开发工程师",
}
#: Directions by words of titles, tried in order after the patterns.
TITLE_WORDS = {
    "前端开发": "前端|web前端|web 前端|react|vue|node",
    "客户端开发": "客户端|ios|android|安卓|app开发|unity|unity3d|u3d|ue|unreal engine|cocos|sdk|游戏客户端|音视频引擎|桌面端",
    "嵌入式开发": "嵌入式|固件|驱动|bsp|firmware",
    "硬件研发": "硬件开发|硬件工程师|功率硬件|电力电子|结构设计工程师|系统集成工程师|硬件结构|音响开发|npi工程师|电子电器",
    "网络与基础设施": "网络规划|网络开发|网络工程师|网络交付|基础架构工程师|数据中心网络|交换机软件|云网络|网络运营|云接入网络",
    "AI Infra": "ai infra|机器学习平台|训练平台|推理平台|训推平台|算力平台|rl infra",
    "高性能计算": "高性能计算|hpc|gpu集群|gpu 集群|编译优化|编译器工程师",
    "汽车软件/智驾研发": "智驾系统|驾驶辅助|智能行车系统|泊车功能开发|底盘集成控制系统开发|底盘电控功能开发工程师|感知质量开发工程师|智驾软件集成|转向电控工程师|制动电控工程师|发动机软件及标定工程师|混动系统开发工程师|混动电驱控制器工程师",
    "运维开发": "运维|sre|devops|infra|可靠性|平台运维|运营运维|运营开发",
    "安全工程": "安全|渗透|攻防|漏洞|dba 安全",
    "测试开发": "测试|qa|评测|开发质量工程师",
    "后端开发": "后台|后端|服务端|全栈|引擎|存储|框架研发|平台研发|dba|数据库|研发岗|架构师岗|软件架构开发|服务器开发|游戏服务器|游戏玩法开发|操作系统研发|linux内核|云存储",
    "数据开发": "数据开发|大数据开发|数据平台|数仓|etl",
    "产品经理": "产品经理|技术产品经理|产品岗|产品实习生",
    "算法工程": "算法|自然语言处理|世界模型|图模型|推理|训练|蒸馏|强化学习|rl|多模态|aigc|游戏ai",
    "AI应用开发": "应用开发工程师|application engineer|应用架构师|应用研究工程师|agent开发工程师|agent 应用|llm application",
}
#: Words that vote for a direction where the title decides nothing.
VOTES = {
    "前端开发": "前端|react|vue|typescript|javascript|web 前端|node|next.js|nextjs",
    "客户端开发": "客户端|ios|android|u3d|unity|ue|ue4|ue5|unreal engine|cocos|移动端|桌面端|sdk|音视频引擎",
    "嵌入式开发": "嵌入式|firmware|固件|驱动|单片机|bsp|rtos",
    "硬件研发": "硬件开发|硬件工程师|电力电子|功率硬件|结构设计|系统集成|npi工程师|声学工程师|电子电器|硬件结构|音响开发",
    "网络与基础设施": "网络规划|网络开发|网络工程师|网络交付|数据中心网络|基础架构|机房网络",
    "AI Infra": "ai infra|ai infrastructure|机器学习平台|训练平台|推理平台|训推平台|模型训练平台|模型推理平台|算力平台|rl infra",
    "高性能计算": "高性能计算|hpc|gpu 集群|gpu集群|计算集群|分布式计算",
    "汽车软件/智驾研发": "智驾系统|驾驶辅助|泊车功能|智能行车系统|车控软件|整车控制软件|智驾软件集成|底盘集成控制系统|底盘电控功能开发|感知质量开发|转向电控|制动电控|发动机软件及标定|混动系统开发|混动电驱控制器",
    "运维开发": "sre|运维|devops|infra|平台运维|云原生|可靠性|idc|网络交付|运营运维",
    "安全工程": "安全工程师|渗透测试|安全研发|漏洞研究|攻防|数据安全|安全运营|安全运营工程师|大模型安全",
    "测试开发": "测试开发|测试工程师|自动化测试|性能测试|测试流程|测试方案|测试任务|代码质量|质量保障|qa|开发质量工程师",
    "后端开发": "后端|后台开发|服务端|java|spring|golang|c++|数据库|分布式|引擎|游戏开发|全栈开发|架构师岗|软件架构开发",
    "数据开发": "数据开发|大数据开发|数仓|etl|spark|flink|数据工程师|数据平台",
    "算法工程": "算法|algorithm engineer|机器学习|深度学习|推理|推理加速|模型训练|模型蒸馏|world model|视频生成|多模态|aigc|生成模型|大模型|nlp|tts|asr|对齐策略|游戏ai",
    "AI应用开发": "ai应用|大模型应用|llm|rag|agent|langchain|langgraph|智能体",
}
#: Signs in titles and texts on which the order of the rules rests.
APPLIED_ROLE = "创新应用工程师|agentic engineer"
ALGORITHM_ROLE = "算法(?:高级|资深|首席)?(?:工程师|研究员|专家|研发)|评测算法(?:工程师|研究员)?"
APPLIED_ALGORITHM = "应用算法|算法应用|大模型应用"
SECURITY_ROLE = "网络(?:与)?(?:信息|数据)?安全|信息安全|数据安全|安全研发|渗透测试|漏洞研究|安全攻防"
SECURITY_RESEARCH, OTHER_SAFETY = r"安全[^\n]{0,8}研究员|研究员[^\n]{0,8}安全", "(?:食品|药物|生物|质量|生产)安全"
RESEARCHER = "研究员"
RESEARCH_FIELD = r"算法|人工智能|机器学习|深度学习|大模型|量化|嵌入式|仿真|机器视觉|计算机视觉|自然语言处理|世界模型|图模型|机器人|医学影像|图像处理|系统智能|(?<![a-z])ai(?:研究员|技术|安全|框架|智能|创新|融合|与|\s*os|\s*infra|\s*for\s*science)|(?<![a-z])ai4science"
MODEL_TEXT, TRAINING_TEXT = r"大模型|\bllm\b", "模型训练|多模态|扩散模型|生成模型|算法"
STRONG_TITLE = r"工程师|开发|算法|测试|研发|后端|前端|客户端|服务端|运维|\bsre\b|架构|\bsdk\b|编译|网络|内核|数据库|固件|驱动"
BUSINESS_TITLE = "项目经理|店长|招商|采销|客户经理|销售经理|销售岗|运营岗|运营经理|用户运营|营销|事务|拓展|关怀专家|服务总监|服务接待|公共安全专家|检验技师"
OTHER_TITLE = r"公关|客服|销售|采销|店长|招商主管|招商|品牌|渠道经理|商品经理|客户经理|结算|物流|采购|运营|商务合作|人力|\bhr\b|财务|法务"
APPLICATION_TITLE, APPLICATION_COPILOT, MODEL_APPLICATION = "应用算法工程师|算法应用", "copilot|创新应用|agentic engineer|应用工程师", "^大模型应用算法工程师$"
ALGORITHM_TEXT = r"post-training|后训练|\brl\b|\brm\b|强化学习|推理优化|推理加速|模型训练|蒸馏|算法研究"
APPLICATION_TEXT = "落地实践|业务场景落地|场景服务|任务自动化|智能对话|推荐与搜索场景|个性化推荐|精准搜索|智能客服|投研分析|风险预警|应用能力|ai paas|prompt|demo|工作流|知识库问答|任务规划|工具调用|记忆能力|badcase|问答链路"
RENAMED, ALGORITHM_AROUND = "ai应用开发", "算法|推理|模型训练|模型蒸馏|world model|世界模型"

#: Directions of English adverts, of which exactly one must show.
ENGLISH = {
    "前端开发": r"front[ -]?end|web front|react|vue|javascript|typescript",
    "后端开发": r"back[ -]?end|server[- ]side|server engineer|java developer|golang|go developer|spring|microservice|distributed systems?|platform engineer|devops engineer|sre|cybersecurity engineer|devsecops engineer|embedded software engineer",
    "数据开发": "data engineer|etl|spark|flink|hadoop|warehouse|analytics engineer",
    "测试开发": "qa|quality assurance|test engineer|software qa|sdet|automation test",
    "算法工程": "machine learning|deep learning|applied scientist|research scientist|research engineer|nlp|computer vision|cv engineer|inference|training|multimodal|data scientist|ml engineer|ai scientist",
    "AI应用开发": "agent|rag|copilot|prompt|ai application|ai enablement|solutions architect|llm engineer|llm application|genai|generative ai",
    "客户端开发": "android|ios|mobile developer|react native|flutter",
}
#: Characters of an English advert that tell its direction: the title and what comes first.
ENGLISH_CHARS = 1200
ENGLISH_DEGREES = {"博士": (r"ph\.?d\.?|doctor(?:ate)?", "ph"), "硕士": (r"master(?:'s)?", "master"), "本科": (r"bachelor(?:'s)?", "bachelor")}
ENGLISH_YEARS = (
    r"\b([0-9]{1,2}\+?\s*(?:years?|yrs?)\s+of\s+experience)\b", r"\b(minimum\s+[0-9]{1,2}\+?\s*(?:years?|yrs?)\b[^.;\n]*)",
    r"\b([0-9]{1,2}\+?\s*(?:years?|yrs?)\s+in\b[^.;\n]*)"
)

#: What stands around a line of a list, and headings that aren't duties; fixed values.
EDGES, NOT_DUTIES = " -•\t", "经验要求|学历要求|任职要求|岗位要求"
DUTIES = 6


def has(c: Column, pattern: str) -> Column:
    """Whether the pattern occurs, in any case, with Unicode words and blanks."""
    return text_or_empty(c).rlike(f"(?iU){pattern}")


def word_pattern(word: str) -> str:
    """A Latin word or name stands apart from other ASCII letters and digits; one with CJK or without letters anywhere."""
    word = word.lower()
    if not re.search("[a-z]", word) or re.search("[一-鿿]", word):
        return f"\\Q{word}\\E"
    edge = lambda c, p: p if c.isalnum() else ""
    return edge(word[0], "(?<![A-Za-z0-9])") + f"\\Q{word}\\E" + edge(word[-1], "(?![A-Za-z0-9])")


def any_word(c: Column, words: str) -> Column:
    """Whether one of the words, parted by bars, occurs in lower-cased ``c``."""
    return c.rlike("|".join(word_pattern(w) for w in words.split("|")))


def degree(text: Column) -> Column:
    """The first degree that the text asks for."""
    return strip(F.regexp_extract(text_or_empty(text), "(?iU)" + "|".join(DEGREE), 0))


def experience(text: Column) -> Column:
    """The years asked for by the first pattern whose first hit names no year above 50."""
    out = F.lit("")
    for pattern in reversed(YEARS):
        hit = F.regexp_extract(text_or_empty(text), f"(?iU){pattern}", 0)
        numbers = F.regexp_extract_all(hit, F.lit(r"(?U)([0-9]+)\s*年"), F.lit(1))
        dated = F.exists(numbers, lambda n: F.coalesce(n.try_cast("decimal(38,0)"), F.lit(MOST_YEARS + 1)) > MOST_YEARS)
        out = F.when((hit != "") & ~dated, strip(F.regexp_replace(hit, r"(?U)^(经验要求|工作经验)[：:]\s*", ""))).otherwise(out)
    return out


def experience_of_meta(meta: Column) -> Column:
    """The years in an advert's other data, a JSON object: the first key whose value tells any."""
    out = F.lit("")
    for key in reversed(YEARS_KEYS):
        v = strip(text_or_empty(F.get_json_object(meta, f"$.{key}")))
        out = F.when(v.isin(*NO_YEARS), ANY_YEARS).when(v.contains("经验") | v.contains("年"), v).otherwise(out)
    return out


def cascade(rules: list[tuple[Column, Column | str]], otherwise: Column) -> Column:
    """The value of the first rule that holds."""
    out = otherwise
    for ok, value in reversed(rules):
        out = F.when(F.coalesce(ok, F.lit(False)), value).otherwise(out)
    return out


def direction(title: Column, text: Column) -> Column:
    """The direction of an advert by rules in order: roles that a title names, titles of other trades, words of the
    title, and last the direction with most words in title and text; empty for none."""

    def of(c: Column) -> Column:
        t, x, whole = c["t"], c["x"], c["whole"]
        strong = has(t, STRONG_TITLE)
        research = strong | has(t, RESEARCH_FIELD) | (has(x, MODEL_TEXT) & has(x, TRAINING_TEXT))
        algorithm = ~has(t, APPLICATION_COPILOT) & has(x, ALGORITHM_TEXT) & (has(t, MODEL_APPLICATION) | ~has(x, APPLICATION_TEXT))
        rules: list[tuple[Column, Column | str]] = [
            (has(t, APPLIED_ROLE), "AI应用开发"),
            (has(t, ALGORITHM_ROLE) & ~has(t, APPLIED_ALGORITHM), "算法工程"),
            (has(t, SECURITY_ROLE) | (has(t, SECURITY_RESEARCH) & ~has(t, OTHER_SAFETY)), "安全工程"),
            (has(t, RESEARCHER) & ~research, ""),
            (has(t, BUSINESS_TITLE) & ~strong, ""),
            *((has(t, p), name) for name, p in TITLE_PATTERNS.items()),
            (has(t, OTHER_TITLE), ""),
            (has(t, APPLICATION_TITLE), F.when(algorithm, "算法工程").otherwise("AI应用开发")),
            *((any_word(t, words), name) for name, words in TITLE_WORDS.items()),
        ]
        votes = {name: sum((whole.rlike(word_pattern(w)).cast("int") for w in words.split("|")), F.lit(0)) for name, words in VOTES.items()}
        return cascade(rules, argmax(votes))

    both = F.struct(
        F.lower(squeezed(title)).alias("t"), F.lower(squeezed(text)).alias("x"),
        F.lower(F.concat(text_or_empty(title), F.lit("\n"), text_or_empty(text))).alias("whole")
    )
    # Bound to a variable, else each rule would squeeze both texts again.
    return F.get(F.transform(F.array(both), of), 0)


def canonical_direction(named: Column, context: Column) -> Column:
    """A direction that was named, by the rules for the title that the context states, else for the name itself."""
    name = squeezed(named)
    stated = strip(F.regexp_extract(text_or_empty(context), r"(?U)岗位名称[：:]\s*([^\n]+)", 1))
    title = F.when(name == "", "").when(stated != "", stated).otherwise(name)
    first = direction(title, context)
    rest = F.when((F.lower(name) == RENAMED) & has(context, ALGORITHM_AROUND), "算法工程").otherwise(
        direction(title, F.concat(name, F.lit("\n"), text_or_empty(context)))
    )
    return F.get(F.transform(F.array(first), lambda d: F.when((name == "") | (d != ""), d).otherwise(rest)), 0)


def effective_direction(row_direction: Column, title: Column, text: Column) -> Column:
    """The labelled direction, else the one that title and text tell."""
    d, t, x = strip(text_or_empty(row_direction)), strip(text_or_empty(title)), strip(text_or_empty(text))
    return F.when(d != "", d).when((t == "") | (x == ""), "").otherwise(direction(t, x))


def bullets(text: Column) -> Column:
    """The lines of a text without what marks them as items."""
    plain = F.transform(lines(text), lambda x: strip(F.regexp_replace(strip(x), r"^[\-•\*\t ]+", "")))
    return F.filter(plain, lambda x: x != "")


def duties(text: Column) -> Column:
    """Lines without marks of items, but for those that begin as another section."""
    plain = F.transform(lines(text), lambda x: F.regexp_replace(x, f"^[{EDGES}]+|[{EDGES}]+$".replace("-", "\\-"), ""))
    return F.filter(plain, lambda x: (x != "") & ~x.rlike(f"^(?:{NOT_DUTIES})"))


def unique_texts(items: Column) -> Column:
    """Squeezed texts, the first of those equal but for case."""
    plain = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), squeezed), lambda x: x != "")
    bound = F.transform(
        F.array(F.struct(plain.alias("p"), F.transform(plain, F.lower).alias("k"))),
        lambda s: F.filter(s["p"], lambda x, i: F.array_position(s["k"], F.lower(x)) == i + 1)
    )
    return F.get(bound, 0)


def english_direction(title: Column, text: Column) -> Column:
    """The only direction that shows in the title and the first characters of an English advert; empty for none or several."""
    near = F.concat(text_or_empty(title), F.lit("\n"), F.substring(text_or_empty(text), 1, ENGLISH_CHARS))
    hits = F.array_compact(F.array(*(F.when(has(near, rf"\b(?:{p})\b"), F.lit(name)) for name, p in ENGLISH.items())))
    return F.when(F.size(hits) == 1, F.get(hits, 0)).otherwise("")


def english_degree(text: Column) -> Column:
    """The highest degree whose first name in an English advert begins as asked; a doctorate by that name is none."""
    first = lambda p: F.lower(F.regexp_extract(text_or_empty(text), rf"(?iU)\b({p})(?:\s+degree)?\b", 1))
    return cascade([(first(p).startswith(start), name) for name, (p, start) in ENGLISH_DEGREES.items()], F.lit(""))


def english_experience(text: Column) -> Column:
    """The years that an English advert asks for."""
    hits = [F.regexp_extract(text_or_empty(text), f"(?iU){p}", 1) for p in ENGLISH_YEARS]
    return cascade([(h != "", squeezed(h)) for h in hits], F.lit(""))


def main_duties(section: Column, text: Column) -> Column:
    """The first lines of the section, else of the whole text."""
    own = duties(section)
    return F.slice(F.when(F.size(own) > 0, own).otherwise(duties(text)), 1, DUTIES)
