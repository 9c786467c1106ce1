"""Lines as printed labels have them, for tests: every rule meets texts that it holds for and such that it does not."""

import random

PIECES = (
    "제품명: 수분 진정 크림", "품명 알로에 젤", "product name: Daily Cream", "내용량: 50 ml", "용량 100g", "net wt 30 oz", "전성분: 정제수, 글리세린, 부틸렌글라이콜, 나이아신아마이드",
    "정제수, 글리세린, 1,2-헥산다이올, 녹차추출물, 스테아릭애씨드", "ingredients: water, glycerin, panthenol, betaine", "정제수글리세린부틸렌글라이콜", "사용방법: 적당량을 덜어 얼굴에 펴 바르세요.",
    "얼굴에 골고루 발라 흡수시켜 주십시오", "apply and massage gently", "사용상의 주의사항: 1) 상처가 있는 부위에는 사용을 자제할 것 2) 어린이의 손이 닿지 않는 곳에 보관할 것", "직사광선을 피해서 보관할 것",
    "눈에 들어가지 않도록 주의하십시오. 사용하지 마세요", "warning: keep away", "효능효과: 피부 진정과 보습에 도움", "보습 20% 강화된 촉촉한 크림", "마치 구름 같은 사용감을 전달하는 크림", "benefits: care",
    "홈페이지 www.label.co.kr", "https://shop.label.com/a?b=1", "고객센터 02-1234-5678", "제조원: (주)라벨 서울특별시 강남구 테헤란로 12", "화장품책임판매업자 라벨 주식회사", "EXP 2026.01.02", "LOT 12345", "제조번호 별도표기",
    "Label Cosmetics Co., Ltd.", "소비자가 12,000원", "the", "AB", "가", "----", "12345", "1588-1234", "500 ml x 3 개", "물", "비타민, 향료, 색소", "오일;버터;왁스;향료", "피이지 8 / PEG-40 하이드로제네이티드캐스터오일",
    "사용순서", "주의", "성분", "QR 코드를 확인하세요", "버리지 말고 분리배출 하십시오", "a, b, c and some words of prose without any end", "Étion dans, çouelle un éonierç", "[새로운] 크림 (신제품) 을 만나 보세요", "토너 ( 대용량 ) , 200ml :새제품",
    "", "  ", "긴 " * 30, "12/31/25", "mm/yy 표시", "유리병 3층 2호", "수분크림을 발라", "인삼추출물 오일 버터 향료 왁스", "소듐하이드록사이드포타슘소듐클로라이드", "brand", "use", "made in korea",
)


def label_texts(n: int = 400, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    joins = (" ", ", ", "", " / ", ": ", "; ", " · ", ",", " ,")
    return [*PIECES, *("".join(x for p in r.choices(PIECES, k=r.randint(2, 4)) for x in (p, r.choice(joins))) for _ in range(n))]
