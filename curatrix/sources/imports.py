"""Rows of public files and of portals as raw adverts, and of public files as résumés and pairs.

Raw adverts are (id, source, url, crawl_time, job_title, company, location, salary, raw_text, html, meta), with ``meta`` a
JSON object. Files come as columns of texts, posts of portals as one column of JSON; what a field is called and where it
goes is declared per shape, and every conversion is one projection. Values that are null, blank or the word none are empty.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.functions.text import language, lines, strip, text_or_empty
from curatrix.functions.values import listed, markup_text, tagged, unescaped, value, wanted
from curatrix.sources.store import read_rows

RAW = ("id", "source", "url", "crawl_time", "job_title", "company", "location", "salary", "raw_text", "html", "meta")


def labelled(*parts: tuple[str, Column] | str | Column) -> Column:
    """Lines of a text: a label with its value where there is one, fixed lines, and bare values where there are any."""

    def line(p) -> Column:
        if isinstance(p, tuple):
            return F.when(p[1] != "", F.concat(F.lit(p[0] + "："), p[1]))
        return F.lit(p) if isinstance(p, str) else F.when(p != "", p)

    return F.concat_ws("\n", *map(line, parts))


def quoted(c: Column) -> Column:
    """A JSON text of a value, other than ASCII as it is."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), c, F.lit('"'))


def digest(**values: Column) -> Column:
    """SHA-1 of a JSON object with sorted keys, parted by comma and blank."""
    parts = [F.concat(F.lit(f'"{k}": '), quoted(values[k])) for k in sorted(values)]
    return F.sha1(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))


def area(place: Column) -> Column:
    """(city, detail) of a place whose parts are set apart by a middle dot."""
    parts = F.filter(F.transform(F.split(text_or_empty(place), "·"), strip), lambda x: x != "")
    dotted = F.contains(text_or_empty(place), F.lit("·"))
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), " / ")
    return F.struct(
        F.when(dotted, F.coalesce(F.get(parts, 0), F.lit(""))).otherwise(text_or_empty(place)).alias("city"),
        F.when(dotted, rest).otherwise("").alias("detail")
    )


def span(low: Column, high: Column, unit: str, above: str, below: str) -> Column:
    """A range with its unit, open at one end where that is missing, empty where both are."""
    has = lambda c: text_or_empty(c) != ""
    return F.when(
        has(low) & has(high), F.concat(low, F.lit("-"), high, F.lit(unit))
    ).when(has(low), F.concat(low, F.lit(unit + above))).when(has(high), F.concat(high, F.lit(unit + below))).otherwise("")


def salary(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """A salary with currency and period."""
    body = F.concat_ws("-", *(F.when(text_or_empty(c) != "", c) for c in (low, high)))
    unit = F.concat_ws("/", *(F.when(value(c) != "", value(c)) for c in (currency, period)))
    return F.when(body == "", "").otherwise(strip(F.concat_ws(" ", body, F.when(unit != "", unit))))


def raw_rows(df: DataFrame, *, source: Column, url: Column, crawl_time: str, meta: dict[str, Column], **columns: Column) -> DataFrame:
    every = {
        "source": source, "url": url, "crawl_time": F.lit(crawl_time), "html": F.lit(None).cast("string"),
        "meta": F.to_json(F.struct(*(c.alias(k) for k, c in meta.items())), {"ignoreNullFields": "false"}), **columns
    }
    return df.select(*(every[n].alias(n) for n in RAW))


def _columns(df: DataFrame) -> Callable[[str], Column]:
    return lambda n: value(F.col(n).cast("string")) if n in df.columns else F.lit("")


def _whole(df: DataFrame) -> Column:
    return F.struct(*df.columns)


def job_site_rows(df: DataFrame, source: str, url: str, crawl_time: str) -> DataFrame:
    """Rows of a table of job offers (job_name, job_area, job_salary, com_name, com_type, com_size, finance_stage, work_year,
    education, job_benefits); those without a name are dropped."""
    v = _columns(df)
    text = labelled(
        ("岗位名称", v("job_name")), ("公司名称", v("com_name")), ("工作地点", v("job_area")), ("薪资范围", v("job_salary")), ("公司行业", v("com_type")),
        ("公司规模", v("com_size")), ("融资阶段", v("finance_stage")), ("经验要求", v("work_year")), ("学历要求", v("education")), ("福利标签", v("job_benefits"))
    )
    key = digest(
        job_title=v("job_name"), company=v("com_name"), location=v("job_area"), salary=v("job_salary"), work_year=v("work_year"),
        education=v("education")
    )
    meta = {
        "schema": F.lit("bosszp_csv_v1"), "language": F.lit("zh"), "sft_ready": F.lit(False), "job_area_city": area(v("job_area"))["city"], "job_area_detail": area(v("job_area"))["detail"],
        "company_type": v("com_type"), "company_size": v("com_size"), "finance_stage": v("finance_stage"), "work_year": v("work_year"), "education": v("education"), "job_benefits": v("job_benefits"),
        "source_file": F.lit(url), "raw_columns": _whole(df),
    }
    rows = raw_rows(
        df, source=F.lit(source), url=F.lit(url), crawl_time=crawl_time, meta=meta, id=F.concat(F.lit(source + "_"), key), job_title=v("job_name"),
        company=v("com_name"), location=v("job_area"), salary=v("job_salary"), raw_text=text
    )
    return rows.filter("job_title <> '' and raw_text <> ''")


def aggregated_rows(df: DataFrame, source: str, url: str, crawl_time: str) -> DataFrame:
    """Rows of a table of collected offers (title, place, salary, experience, education, companytype, industry, provider,
    keyword, description); those without a title are dropped."""
    v = _columns(df)
    text = labelled(
        ("岗位名称", v("title")), ("来源站点", v("provider")), ("关键词", v("keyword")), ("工作地点", v("place")), ("薪资范围", v("salary")), ("经验要求", v("experience")),
        ("学历要求", v("education")), ("公司性质", v("companytype")), ("行业标签", v("industry")), ("职位描述", v("description"))
    )
    key = digest(job_title=v("title"), provider=v("provider"), location=v("place"), salary=v("salary"), experience=v("experience"), education=v("education"))
    meta = {
        "schema": F.lit("workaggregation_csv_v1"), "language": F.lit("zh"), "sft_ready": F.lit(False), "keyword": v("keyword"), "experience": v("experience"), "education": v("education"),
        "company_type": v("companytype"), "industry": v("industry"), "description": v("description"), "source_file": F.lit(url), "raw_columns": _whole(df),
    }
    rows = raw_rows(
        df, source=F.lit(source), url=F.lit(url), crawl_time=crawl_time, meta=meta, id=F.concat(F.lit(source + "_"), key), job_title=v("title"),
        company=v("provider"), location=v("place"), salary=v("salary"), raw_text=text
    )
    return rows.filter("job_title <> '' and raw_text <> ''")


def degree_task_rows(df: DataFrame, source: str, url: str, crawl_time: str, *, min_chars: int = 40) -> DataFrame:
    """Rows of a table of degree questions, whose text has its parts in tags; those with a short description, without an
    answer or without a title are dropped."""
    v = _columns(df)
    said = F.col("user").cast("string")
    name, told, hint = (tagged(said, t) for t in ("岗位名称", "岗位描述", "学历描述"))
    key = digest(job_id=v("job_id"), title=name, description=F.substring(told, 1, 500), assistant=v("assistant"))
    meta = {
        "schema": F.lit("job_educational_parquet_v1"), "language": F.lit("zh"), "sft_ready": F.lit(False), "task_type": F.lit("education_extraction"), "system_prompt": v("system"), "education_label": v("assistant"),
        "education_desc": hint, "user_short": v("user_short"), "user_short2": v("user_short2"), "ai_prediction": v("ai"), "diff": F.coalesce(F.col("diff").cast("boolean"), F.lit(False)) if "diff" in df.columns else F.lit(False),
        "source_file": F.lit(url),
    }
    text = labelled(("岗位名称", name), "任务类型：从岗位中提取学历", "岗位描述：", told, ("学历提示", hint))
    kept = df.filter((F.length(told) >= min_chars) & (v("assistant") != "") & (name != ""))
    ident = F.concat(F.lit(source + "_"), F.when(v("job_id") != "", v("job_id")).otherwise(key))
    return raw_rows(
        kept, source=F.lit(source), url=F.lit(url), crawl_time=crawl_time, meta=meta, id=ident, job_title=name, company=F.lit(""), location=F.lit(""),
        salary=F.lit(""), raw_text=text
    )


#: Words that open offers are kept for and dropped for.
OPEN_FOR = (
    "software", "engineer", "engineering", "developer", "backend", "back-end", "frontend", "front-end", "full stack", "fullstack", "android", "ios", "mobile", "platform", "devops", "sre", "site reliability",
    "cloud", "infrastructure", "data", "machine learning", "ml", "ai ", " ai", "llm", "genai", "security", "qa", "test", "automation",
)
OPEN_AGAINST = (
    "sales", "account executive", "recruiter", "marketing", "designer", "finance", "legal", "operations", "customer support", "talent", "hr ",
    "human resources"
)


def open_offer_rows(
    df: DataFrame, source: str, url: str, crawl_time: str, *, include: list[str] | None = None, exclude: list[str] | None = None, min_chars: int = 600
) -> DataFrame:
    """Rows of a table of open offers with markup; those with a short description or other work are dropped."""
    v = _columns(df)
    places = F.col("locations") if isinstance(df.schema["locations"].dataType, T.ArrayType) else F.array(F.col("locations").cast("string"))
    place = F.array_join(
        F.filter(F.transform(F.coalesce(places, F.array().cast("array<string>")), lambda x: strip(text_or_empty(x))), lambda x: x != ""), " | "
    )
    remote = F.coalesce(F.col("remote").cast("boolean"), F.lit(False)) if "remote" in df.columns else F.lit(False)
    pay = salary(*(F.col(c).cast("string") if c in df.columns else F.lit("") for c in ("salary_min", "salary_max", "salary_currency", "salary_period")))
    # Decoding entities runs in Python once; later steps read its column.
    df = df.withColumn("_described", markup_text(F.col("description_html")))
    text = labelled(
        ("岗位名称", v("title")), ("公司标识", v("source_slug")), ("部门", v("department")), ("工作地点", place), ("雇佣类型", v("employment_type")),
        ("远程", F.when(remote, "是").otherwise("否")), ("薪资范围", pay), "职位描述：", F.col("_described")
    )
    meta = {
        "schema": F.lit("open_apply_jobs_parquet_v1"), "language": F.lit("en"), "sft_ready": F.lit(False), "platform": v("platform"), "source_slug": v("source_slug"), "department": v("department"), "employment_type": v("employment_type"),
        "remote": remote, "posted_at": v("posted_at"), "updated_at": v("updated_at"), "locations": places, "source_file": F.lit(url),
    }
    ident = F.when(v("id") != "", v("id")).otherwise(F.sha1(F.to_json(F.struct(*sorted(c for c in df.columns if c != "_described")))))
    about = F.concat(v("title"), F.lit("\n"), v("department"), F.lit("\n"), F.substring("_described", 1, 400))
    kept = df.filter(
        (F.length("_described") >= min_chars) & (v("title") != "") & wanted(
            about, list(OPEN_FOR) if include is None else include, list(OPEN_AGAINST) if exclude is None else exclude
        )
    )
    return raw_rows(
        kept, source=F.lit(source), url=F.when(v("apply_url") != "", v("apply_url")).otherwise(url), crawl_time=crawl_time, meta=meta, id=ident,
        job_title=v("title"), company=v("source_slug"), location=place, salary=pay, raw_text=text
    )


TYPES = {
    "bosszp_csv": job_site_rows, "workaggregation_csv": aggregated_rows, "job_educational_parquet": degree_task_rows,
    "open_apply_jobs_parquet": open_offer_rows
}
#: What a manifest says of a source and every row of it carries on.
GOVERNANCE = (
    "source_revision", "artifact_sha256", "package_license_status", "content_rights_status", "provenance_status", "intended_usage",
    "training_eligible", "holdout_eligible"
)


def import_source(spark: SparkSession, source: dict, crawl_time: str) -> DataFrame:
    """Raw adverts of one manifest entry, its governance added to their ``meta``."""
    make = TYPES.get(source.get("type"))
    if make is None or not source.get("local_path"):
        raise ValueError(f"a source needs a known type and a local_path: {source}")
    more = {
        "include": source.get("include_keywords"), "exclude": source.get("exclude_keywords"),
        "min_chars": int(source.get("min_description_chars") or 600)
    } if make is open_offer_rows else {}
    rows = make(
        read_rows(spark, source["local_path"]), source.get("name") or "public_dataset", source.get("source_url") or source["local_path"], crawl_time,
        **more
    )
    said = json.dumps({k: source[k] for k in GOVERNANCE if k in source}, ensure_ascii=False)
    return rows.withColumn("meta", F.concat(F.lit(said[:-1] + ", "), F.substring("meta", 2, 1 << 30))) if said != "{}" else rows


def import_sources(spark: SparkSession, manifest: list[dict], crawl_time: str) -> DataFrame:
    """Raw adverts of all enabled entries of a manifest."""
    parts = [import_source(spark, m, crawl_time) for m in manifest if m.get("enabled", True)]
    if not parts:
        raise ValueError("the manifest has no enabled source")
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Portal:
    """How posts of a portal become raw adverts. Paths are those of JSON, several in order of preference."""

    prefix: str
    source: str
    company: str
    url: str  # with {id} and further {path}s
    ident: tuple[str, ...]
    title: tuple[str, ...]
    place: str | Callable[[Column], Column]
    text: tuple  # (label, path), fixed lines, bare paths; a path may be a function of the post
    tech_words: str = ""
    tech: Callable[[Portal, Column], Column] | None = None
    meta: dict[str, str] = field(default_factory=dict)


def at(post: Column, *paths: str) -> Column:
    """The first of a post's values that isn't empty, trimmed."""
    return F.coalesce(*(F.nullif(strip(text_or_empty(F.get_json_object(post, f"$.{p}"))), F.lit("")) for p in paths), F.lit(""))


def names(post: Column, path: str) -> Column:
    """The names of a list of objects."""
    every = F.from_json(F.get_json_object(post, f"$.{path}"), "array<struct<name:string>>")
    return F.array_join(
        F.filter(F.transform(F.coalesce(every, F.array().cast("array<struct<name:string>>")), lambda x: strip(text_or_empty(x["name"]))), lambda x: x != ""),
        " / "
    )


def any_part(c: Column, words: str) -> Column:
    return F.lower(c).rlike("|".join(f"\\Q{w}\\E" for w in words.split("|")))


def _said(post: Column, *paths: str) -> Column:
    return F.concat_ws("\n", *(at(post, p) for p in paths))


def _research_code(p: Portal, post: Column) -> Column:
    return (F.upper(at(post, "jobTypeCode")) == "YANFA") | any_part(
        F.concat_ws("\n", at(post, *p.title), _said(post, "workContent", "qualification")), p.tech_words
    )


def _family(p: Portal, post: Column) -> Column:
    every = any_part(_said(post, "name", "jobFamily", "jobFamilyGroup", "jobDuty", "jobRequirement", "highLight"), p.tech_words)
    product = any_part(at(post, "name"), "产品经理|解决方案产品|ai|agent|平台产品")
    return F.when(at(post, "jobFamily") == "技术类", True).when(at(post, "jobFamily") == "产品类", product).otherwise(every)


def _job_type(p: Portal, post: Column) -> Column:
    every = any_part(_said(post, "jobName", "jobDesc", "qualification", "deptName"), p.tech_words) | any_part(at(post, "jobTypeName", "jobType"), p.tech_words)
    return any_part(at(post, "jobTypeName", "jobType"), "技术|研发|算法|安全|测试|数据|运维|基础平台|客户端|前端|后端") | every


def _family_code(p: Portal, post: Column) -> Column:
    code, product = at(post, "jobFamilyGroupCode"), any_part(at(post, "jobTitle"), "产品经理|平台产品|ai产品|agent产品")
    every = any_part(_said(post, "jobTitle", "jobFamilyGroupName", "requirements", "buName"), p.tech_words)
    return F.when(code.isin("JFG_31", "JFG_32", "JFG_33", "JFG_34", "JFG_35"), True).when(code == "JFG_41", product).otherwise(every)


#: Words of technical work by portal.
_SHORT = "开发|研发|算法|前端|后端|测试|客户端|数据|ai|大模型|模型|java|python|c++|android|ios|机器学习|深度学习|agent"
_MIDDLE = "开发|研发|算法|测试|前端|后端|客户端|android|ios|python|java|go|golang|c++|infra|sre|ai|agent|大模型|数据|平台|架构|sdk|编译|引擎"
_LONG = _MIDDLE + "|安全|运维|机器学习|深度学习|云"
DETAIL_WORDS = "开发|研发|算法|前端|后端|测试|客户端|android|ios|python|java|c++|音视频|sdk|infra|sre|平台|编译|数据|ai|大模型|模型|服务器|中间件"
BOARD_WORDS = _SHORT + "|infra|sre|运维|云|平台|架构"

PORTALS = {
    "tencent": Portal("tencent", "careers.tencent.com", "腾讯", "https://careers.tencent.com/jobdesc.html?postId={id}", ("PostId", "RecruitPostId"), ("RecruitPostName",), "LocationName",
        (("岗位名称", "RecruitPostName"), ("工作地点", "LocationName"), ("事业群", "BGName"), "岗位职责：", ("", "Responsibility"), ("经验要求", "RequireWorkYearsName")),
        meta={"category": "CategoryName", "product": "ProductName", "last_update_time": "LastUpdateTime"}),
    "baidu": Portal("baidu", "talent.baidu.com", "百度", "https://talent.baidu.com/jobs/detail/SOCIAL/{id}", ("postId",), ("name",), "workPlace",
        (
            ("岗位名称", "name"), "公司名称：百度", ("工作地点", "workPlace"), ("职位类别", "postType"), ("业务线", "bgShortName"), ("招聘人数", "recruitNum"),
            ("发布日期", "publishDate"), ("更新时间", "updateDate"), "岗位职责：", ("", "workContent"), "任职要求：", ("", "serviceCondition")
        ),
        meta={
            "job_id": "jobId", "post_type": "postType", "publish_date": "publishDate", "update_date": "updateDate", "recruit_num": "recruitNum",
            "work_years": "workYears", "education": "education", "project_type": "projectType", "bg_short_name": "bgShortName"
        }),
    "jd": Portal("jd_careers", "zhaopin.jd.com", "京东", "https://zhaopin.jd.com/web/job_info_detail?recruitType=2&positionId={positionId}&requirementId={id}", ("requirementId",), ("positionNameOpen", "positionName"), "workCity",
        (
            ("岗位名称", "positionNameOpen positionName"), "公司名称：京东", ("所属业务", "positionDeptName"), ("职位类别", "jobType"), ("工作地点", "workCity"),
            ("职位编号", "reqNumber"), ("发布日期", "formatPublishTime"), "岗位职责：", ("", "workContent"), "任职要求：", ("", "qualification")
        ),
        _SHORT, _research_code, {
            "job_type": "jobType", "job_type_code": "jobTypeCode", "position_id": "positionId", "position_code": "positionCode",
            "position_dept_name": "positionDeptName", "publish_time": "publishTime", "work_city_code": "workCityCode", "req_number": "reqNumber"
        }),
    "meituan": Portal("meituan", "zhaopin.meituan.com", "美团", "https://zhaopin.meituan.com/web/position/detail?jobUnionId={id}", ("jobUnionId",), ("name",), lambda p: names(p, "cityList"),
        (
            ("岗位名称", "name"), "公司名称：美团", ("职位类别", "jobFamily"), ("职位子类", "jobFamilyGroup"), ("工作地点", lambda p: names(p, "cityList")),
            ("经验要求", "workYear"), ("所属部门", lambda p: names(p, "department")), "部门介绍：", ("", "departmentIntro"), "岗位职责：", ("", "jobDuty"), "任职要求：",
            ("", "jobRequirement"), "优先条件：", ("", "precedence"), "职位亮点：", ("", "highLight")
        ),
        _MIDDLE, _family, {
            "job_family": "jobFamily", "job_family_group": "jobFamilyGroup", "work_year": "workYear", "job_duty": "jobDuty",
            "job_requirement": "jobRequirement", "precedence": "precedence", "highlight": "highLight"
        }),
    "didi": Portal("didi", "talent.didiglobal.com", "滴滴", "https://talent.didiglobal.com/social/p/{id}", ("jdId",), ("jobName",), "workArea",
        (
            ("岗位名称", "jobName"), "公司名称：滴滴", ("所属部门", "deptName"), ("工作地点", "workArea"), ("职位类别", "jobTypeName jobType"), ("招聘类型", "recruitType"),
            ("职位编号", "jdNo"), ("招聘人数", "recruitNum"), ("发布时间", "publishTime"), ("刷新时间", "refreshTime"), "岗位职责：", ("", "jobDesc"), "任职要求：",
            ("", "qualification")
        ),
        _LONG, _job_type, {
            "jd_no": "jdNo", "dept_name": "deptName", "publish_time": "publishTime", "refresh_time": "refreshTime", "recruit_type": "recruitType",
            "recruit_num": "recruitNum", "job_type": "jobType", "record_id": "recordId"
        }),
    "ctrip": Portal("ctrip", "careers.ctrip.com", "携程", "https://careers.ctrip.com/#/experienced/job-detail/{jobId id}", ("id",), ("jobTitle",), "cityName",
        (
            ("岗位名称", "jobTitle"), "公司名称：携程", ("业务线", "buName"), ("工作地点", "cityName"), ("职位类别", "jobFamilyGroupName"),
            ("职位类别编码", "jobFamilyGroupCode"), ("招聘类型", "kindName kind"), ("发布时间", "publishDate"), ("职位外部编号", "fromId"), ("职位内部编号", "jobId"), "职位描述：",
            ("", "requirements")
        ),
        _LONG, _family_code, {
            "from_id": "fromId", "job_id": "jobId", "publish_date": "publishDate", "job_family_group_code": "jobFamilyGroupCode",
            "job_family_group_name": "jobFamilyGroupName", "bu_name": "buName", "kind": "kind", "city_name": "cityName"
        }),
}


def _path(post: Column, path) -> Column:
    return path(post) if callable(path) else at(post, *path.split())


def probably_technical(portal: Portal, post: Column) -> Column:
    """Whether a post is one of technical work by the portal's own codes, else by words; all are without a rule."""
    return F.coalesce(portal.tech(portal, post), F.lit(False)) if portal.tech else F.lit(True)


def post_rows(df: DataFrame, portal: Portal, crawl_time: str, post: str = "post", **more: Column) -> DataFrame:
    """Raw adverts of posts, a column of JSON; posts without an id are dropped. ``more`` goes into ``meta``."""
    c = F.col(post)
    ident = at(c, *portal.ident)
    parts = [p if isinstance(p, str) else (_path(c, p[1]) if not p[0] else (p[0], _path(c, p[1]))) for p in portal.text]
    url, rest = F.lit(""), portal.url
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        url = F.concat(url, F.lit(before), ident if name == "id" else at(c, *name.split()))
    url = F.concat(url, F.lit(rest))
    text = labelled(*parts)
    meta = {
        "language": F.when(text.rlike("[一-鿿]"), "zh").otherwise("en"), "sft_ready": probably_technical(portal, c), "post_id": ident,
        **{k: F.get_json_object(c, f"$.{p}") for k, p in portal.meta.items()}, **more
    }
    kept = df.filter(ident != "")
    return raw_rows(
        kept, source=F.lit(portal.source), url=url, crawl_time=crawl_time, meta=meta, id=F.concat(F.lit(portal.prefix + "_"), ident),
        job_title=at(c, *portal.title), company=F.lit(portal.company), location=_path(c, portal.place), salary=F.lit(""), raw_text=text
    )


def places(post: Column, path: str = "locations") -> Column:
    """The distinct places of a list of objects with country, province, city, area and address."""
    kind = "array<struct<country:string,province:string,city:string,area:string,address:string>>"
    every = F.coalesce(F.from_json(F.get_json_object(post, f"$.{path}"), kind), F.array().cast(kind))
    one = lambda x: F.concat_ws(
        " / ", *(F.nullif(strip(text_or_empty(x[k])), F.lit("")) for k in ("country", "province", "city", "area", "address"))
    )
    return F.array_join(F.array_distinct(F.filter(F.transform(every, one), lambda x: x != "")), " | ")


def board_rows(
    df: DataFrame, org: str, company: str, mode: str, source: str, url: str, crawl_time: str, site: int | None = None, post: str = "post"
) -> DataFrame:
    """Raw adverts of the posts of one organisation's board; posts without an id are dropped."""
    c = F.col(post)
    df = df.filter(at(c, "id") != "").withColumn("_described", markup_text(F.get_json_object(c, "$.description")))
    pay = span(at(c, "minSalary"), at(c, "maxSalary"), "K", "以上", "以内")
    years = span(at(c, "minExperience"), at(c, "maxExperience"), "年", "以上", "以内")
    text = labelled(
        ("岗位名称", at(c, "title")), ("公司名称", F.lit(company)), "招聘模式：" + ("社招" if mode == "social" else "校招"), ("工作地点", places(c)), ("薪资范围", pay), ("学历要求", at(c, "education")), ("经验要求", years),
        ("职位性质", at(c, "commitment")), ("所属部门", at(c, "department.name")), ("职能类别", at(c, "zhineng.name")), ("发布时间", at(c, "publishedAt")), ("更新时间", at(c, "updatedAt")), "职位描述：", F.col("_described"),
    )
    tongue = language(text)
    technical = any_part(F.concat_ws("\n", text, at(c, "department.name"), at(c, "zhineng.name")), BOARD_WORDS)
    kept = {
        "status": "status", "education": "education", "min_experience": "minExperience", "max_experience": "maxExperience",
        "commitment": "commitment", "published_at": "publishedAt", "updated_at": "updatedAt", "opened_at": "openedAt", "closed_at": "closedAt",
        "hire_mode": "hireMode", "number": "number"
    }
    meta = {
        "schema": F.lit("moka_jobs_v1"), "language": tongue, "sft_ready": (tongue == "zh") & technical, "org_id": F.lit(org), "job_id": at(c, "id"), "mode": F.lit(mode), "site_id": F.lit(site).cast("int"),
        **{k: F.get_json_object(c, f"$.{p}") for k, p in kept.items()}, "source_url": F.lit(url),
    }
    page = f"https://app.mokahr.com/{'social' if mode == 'social' else 'campus'}-recruitment/{org}{'' if site is None else f'/{site}'}#/"
    return raw_rows(
        df, source=F.lit(source), url=F.lit(page), crawl_time=crawl_time, meta=meta, id=F.concat(F.lit(f"moka_{org}_{mode}_"), at(c, "id")),
        job_title=at(c, "title"), company=F.lit(company), location=places(c), salary=pay, raw_text=text
    )


#: How a portal's list and detail pages are written, and places that it names in Latin letters.
LIST_ROW = r'(?s)<tr>\s*<td class="first"><a href="(https://hr\.xiaomi\.com/job/view/(\d+))">(.*?)(?:<span class="hot-tip"></span>)?</a></td>\s*<td>(.*?)</td>\s*<td>(.*?)</td>\s*<td>(.*?)</td>\s*</tr>'
DETAIL_FIELD = r'(?s)<td class="details-title(?: require)?">([^<：]+)：</td>\s*<td class="(?:job-details|details-list)"(?:\s+colspan="\d+")?>(.*?)</td>'
PLACES = {"peking": "北京", "beijing": "北京", "wuhan": "武汉", "shanghai": "上海", "nanjing": "南京", "guangzhou": "广州", "shenzhen": "深圳"}


def _plain(c: Column) -> Column:
    """Markup as text, hard blanks as blanks."""
    broken = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), "(?i)</(p|div|li|ul|ol)>", "\n")
    return strip(F.regexp_replace(F.translate(F.regexp_replace(broken, "<[^>]+>", ""), " ", " "), "\n{3,}", "\n\n"))


def known_place(c: Column) -> Column:
    out = c
    for latin, name in PLACES.items():
        out = F.when(F.lower(c) == latin, name).otherwise(out)
    return out


def list_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """(href, job_id, title, category, location, publish_date) of the rows of list pages."""
    df = pages.withColumn("_page", unescaped(F.col(html)))
    each = [F.regexp_extract_all("_page", F.lit(LIST_ROW), F.lit(g)) for g in range(1, 7)]
    r = df.select(
        F.explode(
            F.arrays_zip(*(c.alias(n) for c, n in zip(each, ("href", "job_id", "title", "category", "location", "publish_date"), strict=True)))
        ).alias("r")
    ).select("r.*")
    return r.select(
        "href", "job_id", _plain(F.col("title")).alias("title"), _plain(F.col("category")).alias("category"),
        known_place(_plain(F.col("location"))).alias("location"), _plain(F.col("publish_date")).alias("publish_date")
    )


def detail_fields(page: Column) -> Column:
    """A map from the labels of a detail page to their values; of labels that repeat the last counts."""
    both = F.arrays_zip(
        F.regexp_extract_all(text_or_empty(page), F.lit(DETAIL_FIELD), F.lit(1)).alias("k"),
        F.regexp_extract_all(text_or_empty(page), F.lit(DETAIL_FIELD), F.lit(2)).alias("v")
    )
    clean = F.filter(F.transform(both, lambda x: F.struct(_plain(x["k"]).alias("k"), _plain(x["v"]).alias("v"))), lambda x: (x["k"] != "") & (x["v"] != ""))
    last = lambda xs: F.filter(xs, lambda x, i: ~F.exists(F.slice(xs, i + 2, F.size(xs) + 1), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(F.get(F.transform(F.array(clean), last), 0))


def detail_rows(rows: DataFrame, crawl_time: str, list_path: str) -> DataFrame:
    """Raw adverts of list rows with ``fields``, the map of their detail page."""
    f = lambda *keys: F.coalesce(*(F.try_element_at("fields", F.lit(k)) for k in keys), F.lit(""))
    name, category = F.coalesce(F.nullif(f("职位名称"), F.lit("")), "title"), F.coalesce(F.nullif(f("职位类别"), F.lit("")), "category")
    place = known_place(F.coalesce(F.nullif(f("工作地点"), F.lit("")), F.col("location")))
    does, needs = f("工作职责", "岗位职责"), f("工作要求", "任职要求", "任职资格")
    text = labelled(
        ("岗位名称", name), "公司名称：小米", ("工作地点", place), ("职位类别", category), ("招聘渠道", f("招聘渠道")), ("发布日期", F.col("publish_date")), "岗位职责：", does, "任职要求：",
        needs
    )
    meta = {
        "language": F.lit("zh"), "sft_ready": any_part(F.concat_ws("\n", name, text), DETAIL_WORDS), "job_id": F.col("job_id"), "category": category, "publish_date": F.col("publish_date"),
        "channel": f("招聘渠道"), "duties": does, "requirements": needs, "list_path": F.lit(list_path), "detail_fields": F.col("fields"),
    }
    return raw_rows(
        rows, source=F.lit("hr.xiaomi.com"), url=F.col("href"), crawl_time=crawl_time, meta=meta, id=F.concat(F.lit("xiaomi_"), "job_id"),
        job_title=name, company=F.lit("小米"), location=place, salary=F.lit(""), raw_text=text
    )


#: Signs of pages that hold no advert, and of those that do.
NO_PAGE, ADVERT_WORDS, LEAST_CHARS = "not found|no encontrada|404", "岗位|职位|任职|职责", 120


def is_advert_page(html: Column, title: Column, text: Column) -> Column:
    page = F.lower(text_or_empty(html))
    hidden = page.contains('name="robots"') & page.contains("noindex")
    return ~F.lower(text_or_empty(title)).rlike(NO_PAGE) & ~hidden & (F.length(text_or_empty(text)) >= LEAST_CHARS) & text_or_empty(text).rlike(ADVERT_WORDS)


def _mapped(df: DataFrame, mapping: dict[str, str], key: str) -> Column | None:
    """The column at a mapped dotted path, null where the rows have no such path."""
    path = mapping.get(key)
    if not path:
        return None
    kind: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return F.col(path)


def _listed(df: DataFrame, mapping: dict[str, str], key: str) -> Column:
    c = _mapped(df, mapping, key)
    if c is None:
        return F.array().cast("array<string>")
    if isinstance(df.select(c.alias("c")).schema["c"].dataType, T.ArrayType):
        return F.filter(F.transform(F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")), value), lambda x: x != "")
    return listed(c.cast("string"))


def _origin(source: dict, kind: str, **defaults: str) -> dict[str, Column]:
    v = lambda k, d="": F.lit(str(source.get(k) or d))
    return {"source_name": v("name"), "schema": F.lit(kind), **{k: v("path" if k == "source_path" else k, d) for k, d in defaults.items()}}


def _numbered(df: DataFrame, source: dict, index: str, *texts: Column) -> Column:
    """An id from the source's name, the row's number and its texts."""
    return F.concat(F.lit(source["name"] + "_"), F.substring(F.sha1(F.concat_ws("::", F.lit(source["name"]), F.col(index).cast("string"), *texts)), 1, 12))


def resume_rows(df: DataFrame, source: dict, index: str = "index") -> DataFrame:
    """Résumés (id, task, source_type, text, label, meta) of rows by the source's mapping; those without text are dropped.

    ``index`` is the column with the row's number in its file.
    """
    m = source.get("mapping") or {}
    text = value(_mapped(df, m, "text").cast("string")) if _mapped(df, m, "text") is not None else F.lit("")
    target = _mapped(df, m, "target_job")
    label = F.struct(
        (value(target.cast("string")) if target is not None else F.lit("")).alias("目标岗位"),
        *(
            _listed(df, m, k).alias(n) for k,
            n in (("education", "教育背景"), ("skills", "核心技能"), ("internships", "实习经历"), ("projects", "项目经历"), ("strengths", "优势标签"))
        ),
    )
    meta = _origin(source, "resume_parse_rows", language="zh", source_path="", license="", license_status="unconfirmed", intended_usage="audit_only")
    out = df.select(
        _numbered(df, source, index, text).alias("id"), F.lit("resume_parse").alias("task"),
        F.lit(source.get("source_type") or "public_text").alias("source_type"), text.alias("text"), label.alias("label"),
        F.struct(*(c.alias(k) for k, c in meta.items())).alias("meta")
    )
    return out.filter("text <> ''")


def resume_tag_rows(df: DataFrame, source: dict, index: str = "index") -> DataFrame:
    """Tagged résumés (id, task, source_type, text, tokens, ner_tags, meta); rows without tokens are dropped."""
    m = source.get("mapping") or {}
    tokens = F.coalesce(_mapped(df, m, "tokens").cast("array<string>"), F.array().cast("array<string>"))
    tags = _mapped(df, m, "tags")
    tags = F.coalesce(tags.cast("array<string>"), F.array().cast("array<string>")) if tags is not None else F.array().cast("array<string>")
    text = F.array_join(tokens, "")
    meta = _origin(
        source, "resume_ner_rows", language="zh", tag_scheme="BIO", source_path="", license="", license_status="unconfirmed",
        intended_usage="audit_only"
    )
    out = df.select(
        _numbered(df, source, index, text).alias("id"), F.lit("resume_ner").alias("task"),
        F.lit(source.get("source_type") or "public_text").alias("source_type"), text.alias("text"), tokens.alias("tokens"),
        tag_names(tags, source.get("tag_names") or {}).alias("ner_tags"), F.struct(*(c.alias(k) for k, c in meta.items())).alias("meta")
    )
    return out.filter(F.size("tokens") > 0)


def tag_names(tags: Column, named: dict) -> Column:
    """Tags by name; those without one stay."""
    if not named:
        return tags
    known = F.create_map(*(F.lit(str(x)) for pair in named.items() for x in pair))
    return F.transform(tags, lambda t: F.coalesce(F.try_element_at(known, t), t))


def pair_rows(df: DataFrame, source: dict, index: str = "index") -> DataFrame:
    """Pairs (id, task, source_type, jd_text, resume_text, label, meta) of rows by the source's mapping; those without
    both texts are dropped."""
    m = source.get("mapping") or {}
    of = lambda k: _mapped(df, m, k).cast("string") if _mapped(df, m, k) is not None else F.lit("")
    left, right = value(of("jd_text")), value(of("resume_text"))
    label = F.struct(of("label").alias("raw_label"), of("score").alias("raw_score"))
    meta = _origin(
        source, "match_pair_rows", language="unknown", source_path="", source_url="", source_revision="", provenance_status="undocumented",
        license_status="unconfirmed", intended_usage="audit_only"
    )
    out = df.select(
        _numbered(df, source, index, left, right).alias("id"), F.lit("match").alias("task"),
        F.lit(source.get("source_type") or "public_pair").alias("source_type"), left.alias("jd_text"), right.alias("resume_text"),
        label.alias("label"), F.struct(*(c.alias(k) for k, c in meta.items())).alias("meta")
    )
    return out.filter("jd_text <> '' and resume_text <> ''")


CONVERTERS = {"resume_parse_rows": resume_rows, "resume_ner_rows": resume_tag_rows, "match_pair_rows": pair_rows}


def convert_rows(df: DataFrame, source: dict, index: str = "index") -> DataFrame:
    """Rows of a source by its schema."""
    if source.get("schema") not in CONVERTERS:
        raise ValueError(f"unknown schema {source.get('schema')}")
    return CONVERTERS[source["schema"]](df, source, index)


#: Headings of written résumés; a heading is a short line that holds one of the words.
RESUME_HEADINGS = {
    "education": ("教育背景", "教育经历"), "skills": ("专业技能", "核心技能", "技能"), "internships": ("实习经历", "工作经历"), "projects": ("项目经验", "项目经历"),
    "strengths": ("其他亮点", "优势", "自我评价")
}
HEADING_CHARS, SECTION_LINES = 24, 12


def written_sections(text: Column, headings: dict[str, tuple[str, ...]] = RESUME_HEADINGS) -> Column:
    """A struct of the first lines below each heading of a marked-up résumé."""
    plain = F.filter(
        F.transform(lines(text), lambda x: strip(F.regexp_replace(F.regexp_replace(x, r"(?U)^[\s#>*-]+", ""), r"\*\*", ""))),
        lambda x: (x != "") & (x != "---")
    )

    def heading(x: Column) -> Column:
        out = F.lit("")
        for name, words in reversed(headings.items()):
            out = F.when((F.length(x) <= HEADING_CHARS) & x.rlike("|".join(f"\\Q{w}\\E" for w in words)), name).otherwise(out)
        return out

    marked = F.transform(plain, lambda x: F.concat(heading(x), F.lit("\x01"), x))
    # A heading cuts the text; what follows it up to the next belongs to it.
    cut = F.slice(
        F.split(
            F.array_join(
                F.transform(marked, lambda m: F.when(m.startswith("\x01"), m).otherwise(F.concat(F.lit("\x02"), F.substring_index(m, "\x01", 1)))),
                "\n"
            ),
            "\x02"
        ),
        F.lit(2), F.lit(1 << 30)
    )
    of = lambda name: F.slice(
        F.flatten(
            F.transform(
                F.filter(cut, lambda p: F.substring_index(p, "\n", 1) == name),
                lambda p: F.filter(
                    F.transform(F.slice(F.split(p, "\n"), F.lit(2), F.lit(1 << 30)), lambda x: F.regexp_replace(x, "\x01", "")),
                    lambda x: F.length(x) >= 2
                )
            )
        ),
        1, SECTION_LINES
    )
    return F.struct(*(of(n).alias(n) for n in headings))


def written_resumes(df: DataFrame, source_name: str) -> DataFrame:
    """(text, label, meta) of marked-up résumés (content, metadata.position); those without content are dropped."""
    text = strip(text_or_empty(F.col("content")))
    found = df.filter(text != "").withColumn("_s", written_sections(text))
    label = F.struct(
        strip(text_or_empty(F.col("metadata.position"))).alias("目标岗位"),
        *(
            F.col(f"_s.{k}").alias(n) for k,
            n in (("education", "教育背景"), ("skills", "核心技能"), ("internships", "实习经历"), ("projects", "项目经历"), ("strengths", "优势标签"))
        )
    )
    return found.select(
        text.alias("text"), label.alias("label"),
        F.struct(F.lit(source_name).alias("source_name"), F.lit("public_synthetic_resume").alias("source_kind")).alias("meta")
    )
