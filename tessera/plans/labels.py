"""Label text made of the parts table: every kind of line that the rules know, in Spark and in SQL, for queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of labels; {n} is a part's name, {s} its size.
TEMPLATES = (
    "제품명: 수분 진정 크림 {n}", "{n} 알로에 젤 {s}", "product name: {n} Cream", "내용량: {s} ml", "용량 {s}g", "net wt {s} oz", "전성분: 정제수, 글리세린, 부틸렌글라이콜, 나이아신아마이드", "정제수, 글리세린, 1,2-헥산다이올, 녹차추출물, 스테아릭애씨드",
    "ingredients: water, glycerin, panthenol, betaine", "정제수글리세린부틸렌글라이콜판테놀", "사용방법: 적당량을 덜어 얼굴에 펴 바르세요.", "얼굴에 골고루 발라 흡수시켜 주십시오", "apply {n} and massage gently", "사용순서",
    "사용상의 주의사항: 1) 상처가 있는 부위에는 사용을 자제할 것 2) 어린이의 손이 닿지 않는 곳에 보관할 것", "직사광선을 피해서 보관할 것", "눈에 들어가지 않도록 주의하십시오. 사용하지 마세요", "warning: keep away", "주의",
    "효능효과: 피부 진정과 보습에 도움", "보습 {s}% 강화된 촉촉한 크림 {n}", "마치 구름 같은 사용감을 전달하는 크림", "benefits: care for {n}", "홈페이지 www.label{s}.co.kr", "https://shop.label.com/{s}?b=1", "고객센터 02-1234-5678",
    "제조원: (주)라벨 서울특별시 강남구 테헤란로 {s}", "화장품책임판매업자 라벨 주식회사", "EXP 2026.01.02", "LOT {s}345", "제조번호 별도표기", "Label Cosmetics Co., Ltd.", "소비자가 12,000원", "the", "AB", "가", "----", "{s}", "1588-1234", "{s} ml x 3 개",
    "비타민, 향료, 색소", "오일;버터;왁스;향료", "피이지 8 / PEG-40 하이드로제네이티드캐스터오일, {n}", "성분", "QR 코드를 확인하세요", "버리지 말고 분리배출 하십시오", "a, b, c and some words about {n} without any end", "토너 ( 대용량 ) , {s}ml :새제품 {n}",
    "[새로운] {n} (신제품) 을 만나 보세요", "유리병 {s}층 2호", "수분크림을 바르고 {n} 세안 후 물로 씻어 주세요", "인삼추출물 오일 버터 향료 왁스 색소", "소듐하이드록사이드포타슘소듐클로라이드", "{n}", "{n}, 정제수, 토코페롤 {s}, 카보머, 알란토인", "made in korea {s}",
)
#: Lines of a label.
LINES = 12


def label_documents(parts: DataFrame) -> DataFrame:
    """(doc_id, lang, text): a label of LINES lines for each part, which lines depends on key and size."""
    every = F.array(*(F.lit(t) for t in TEMPLATES))
    line = lambda i: F.element_at(every, ((F.col("p_partkey") * 7 + F.col("p_size") * i + i * i * 5) % len(TEMPLATES) + 1).cast("int"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(LINES - 1)), line), "\n")
    filled = F.replace(F.replace(text, F.lit("{n}"), F.col("p_name")), F.lit("{s}"), F.col("p_size").cast("string"))
    return parts.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("l"), (F.col("p_partkey") % 3).cast("string")).alias("lang"), filled.alias("text"))


_LIST = "[" + ", ".join("'{}'".format(t.replace("'", "''")) for t in TEMPLATES) + "]"
#: The same in SQL.
DOCUMENTS = f"""SELECT p_partkey AS doc_id, 'l' || (p_partkey % 3) AS lang, replace(replace(array_to_string(list_transform(range({LINES}), lambda i: {_LIST}[(p_partkey * 7 + p_size * i + i * i * 5) % {len(TEMPLATES)} + 1]), chr(10)), '{{n}}', p_name), '{{s}}', p_size::VARCHAR) AS text FROM part"""


def over_labels(sql: str) -> str:
    """A query over documents as one over label texts."""
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(head):
            return f"{head}documents AS ({DOCUMENTS}), {sql.removeprefix(head)}"
    return f"WITH documents AS ({DOCUMENTS}) {sql}"
