"""Rule-sets: keywords, patterns and thresholds that the operators take as data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: How "nothing known" is written at the edge, and all the spellings of it that are dropped on reading. Fixed values.
UNKNOWN = "확인 불가"
SENTINELS = (UNKNOWN, "없음", "null", "None", "none", "N/A", "n/a", "unknown", "Unknown")

SECTIONS = ("product_name", "capacity", "ingredients", "usage", "cautions", "effects", "qr_url", "others")

#: Syllables that end in the consonant rieul: every 28th one from U+AC00, the eighth of each.
RIEUL = "".join(chr(c) for c in range(0xAC00, 0xD7A4) if (c - 0xAC00) % 28 == 8)
#: Looks whether a syllable stands before that word at all, since a class of so many single characters is slow to test.
BEFORE_THING = r"(?=[가-힣](?U:\s)*것)"


@dataclass(frozen=True)
class RuleSet:
    """The words and patterns of printed product labels, in Korean and English."""

    product: tuple[str, ...] = ("제품명", "제품 명", "품명", "상품명", "제품이름", "제품 이름", "product name", "item name", "name")
    capacity: tuple[str, ...] = ("내용량", "순중량", "충전량", "용량", "중량", "net wt", "net weight", "volume", "capacity", "contents")
    ingredients: tuple[str, ...] = (
        "전성분", "전 성분", "전 성 분", "주요성분", "주요 성분", "주성분", "주 성분", "주 성 분", "성분명", "원료명", "성분", "원료",
        "ingredient list", "main ingredients", "key ingredients", "ingredients", "ingredient",
    )
    usage: tuple[str, ...] = ("사용방법", "사용 방법", "사용순서", "사용 순서", "사용법", "용법", "how to use", "directions", "direction", "usage", "use")
    cautions: tuple[str, ...] = (
        "사용상주의사항", "사용 시의 주의사항", "사용시주의사항", "사용할 때의 주의사항", "사용 상 주의사항", "주의사항", "경고", "주의",
        "warning", "caution", "precautions", "precaution", "화기주의", "가연성",
    )
    effects: tuple[str, ...] = (
        "효능효과", "효능 효과", "효능", "효과", "주요기능", "주요 기능", "기능성", "기능", "주요특징", "주요 특징", "제품특징", "제품 특징", "특징", "장점",
        "benefits", "benefit", "effects", "effect", "features", "feature", "claims",
    )
    effects_content: tuple[str, ...] = (
        "진정", "보습", "수분", "촉촉", "탄력", "광채", "케어", "보호", "완화", "개선", "도움", "영양", "윤기", "생기", "활력", "주름", "미백", "재생", "회복", "쿨링", "선사", "전달",
    )
    links: tuple[str, ...] = ("웹사이트", "사이트", "홈페이지", "homepage", "www", "http", "https", "url", "qr", ".com", ".co.kr", ".kr", ".net", ".org", ".io", ".ai")
    makers: tuple[str, ...] = (
        "제조원", "제조업자", "책임판매업자", "판매업자", "화장품책임판매업자", "제조판매업자", "고객센터", "고객상담실", "소비자상담", "소비자상담실",
        "주소", "제조번호", "제조일자", "사용기한", "유통기한", "품질보증기준", "제품개발", "기술지원", "manufacturer", "distributor", "customer center",
        "exp", "mfg", "lot", "batch", "분쟁해결", "공정거래", "교환", "반품", "분리수거", "분리배출", "빈용기", "재활용", "제조국", "원산지", "made in",
        "판매원", "수입원", "barcode", "바코드", "전화", "문의",
    )
    storage: tuple[str, ...] = ("보관방법", "보관 방법", "보관상 주의사항", "직사광선", "고온", "저온", "보관", "storage")
    not_ingredients: tuple[str, ...] = (
        "사용후", "사용 후", "사용하지", "사용하고", "사용하기", "바릅니다", "발라", "흡수", "마사지", "세안", "도포", "주의", "화기", "화기주의", "가연성", "가스", "환기", "불",
        "버리지", "장소", "보관", "경우", "반드시", "하십시오", "하세요", "합니다", "됩니다", "있습니다", "상담", "고객", "소비자", "제조", "판매", "주소",
        "교환", "반품", "분쟁", "공정거래", "분리수거", "분리배출", "용기", "상품", "상표", "원산지", "품질보증", "제조번호", "사용기한", "유통기한",
    )
    noise: tuple[str, ...] = ("for", "cfor", "the", "and", "from", "with", "made", "in", "소비자가", "만드는신문", "신문", "brand", "nobrand", "no brand")
    not_capacity: tuple[str, ...] = ("제조번호", "제조일자", "사용기한", "유통기한", "exp", "mfg", "별도표", "lot", "batch", "전화", "고객센터", "소비자상담")
    usage_signals: tuple[str, ...] = ("사용방법", "사용법", "사용순서", "apply", "massage", "rinse", "wash", "directions", "directions for use")
    caution_signals: tuple[str, ...] = (
        "주의사항", "사용상주의", "피부이상", "붉은반점", "부어오름", "가려움", "자극", "상처", "습진", "피부염", "직사광선", "어린이", "화기", "경고", "warning", "caution", "precaution",
    )
    strong_cautions: tuple[str, ...] = ("주의사항", "자제", "보관할", "피해서", "어린이", "상처")

    usage_ending: str = r"(?i)(?:하|발라|적[셔신]|뿌리|짜|덜|문지[르러]|닦|씻|적[셔시]|두[드들]|바|펴|얇게|넓게|적당량|소량|세요|십시오|십시요|시오|합니다|냅니다|줍니다|줍시다|드립니다)(?:(?U:\s)*[.!]?(?U:\s)*)?$"
    caution_ending: str = "(?i)(?:" + BEFORE_THING + "[" + RIEUL + r"](?U:\s)*것|마세요|마십시오|마라|말아라|금지|자제|피하[세십]|피할(?U:\s)*것|하지(?U:\s)*(?:말|마|않)|않도록|안(?U:\s)*돼|안돼)"
    company: str = r"(?i)(?:주식(?U:\s)*회사|유한(?U:\s)*회사|유한책임(?U:\s)*회사|\((?U:\s)*주(?U:\s)*\)|co\.?(?U:\s)*,?(?U:\s)*ltd\.?|inc\.?|corp\.?|llc\.?|gmbh|s\.?a\.?|판매(?U:\s)*유한(?U:\s)*회사|책임판매업자|제조판매업자|화장품책임판매업자)"
    address: str = r"(?:특별시|광역시|특별자치시|특별자치도|[가-힣]{2,}(?U:\s)*(?:구|군)(?U:\s)+[가-힣]|[가-힣]{2,}(?U:\s)*(?:로|길)(?U:\s)*\d+|\d+(?U:\s)*(?:번지|층|호))"
    phone: str = r"(?<!\d)(?:\d{2,4}[-\s.]\d{3,4}[-\s.]\d{4}|1\d{3}[-\s.]?\d{4}|\+?\d{1,3}[-\s.]\d{1,4}[-\s.]\d{3,4}[-\s.]\d{4})(?!\d)"
    lot: str = r"(?i)(?:exp|mfg|lot|batch|prod|use\s*by|best\s*by|제조\s*번호|제조\s*일자|제조\s*년월일|사용\s*기한|유통\s*기한|소비\s*기한|표시\s*숫자|별도\s*표[시기])"
    date: str = r"(?i)(?:20\d{2}|19\d{2})[.\-/년]\s*\d{1,2}[.\-/월]\s*\d{0,2}|\d{4}\.\d{2}\.\d{2}|\d{2}/\d{2}/\d{2,4}|mm\s*/\s*y{1,4}"
    suffix: str = (
        r"(?:추출물|오일|버터|왁스|애[씨시]드|산(?![가-힣A-Za-z0-9_])|올(?![가-힣A-Za-z0-9_])|에놀|에이트|레이트|이드|아이드|마이드|클로라이드|글라이콜|글리세린|폴리머|폴리올|에테르|에스테르|"
        r"아민|아민산|하이드록사이드|설페이트|페이트|실리콘|실란|세틸|세테아릴|스테아릴|라우릴|향료|색소|비타민|에센스|단백질)"
    )
    advert: str = (
        r"(?:\d+\s*%\s*(?:증가|함유|보강|강화|개선|상승|향상)|(?:증가된|보강된|개선된|강화된|향상된|풍부한|진한|새로운|가득한|담은|만든|위한|에서|을\s*위한|로서|함유)|마치\s*[가-힣]+|[가-힣]+\s*(?:같은|듯한|처럼))"
    )
    polite: str = r"(하십시오|하세요|합니다|됩니다|있습니다|하지말것|버리지말것|사용하지)"
    amount: str = r"(?i)\d+(?:\.\d+)?\s?(?:ml|g|kg|mg|oz|fl\.?\s?oz|매|pcs|ea|개)"
    url: str = r"(?i)https?://|www\.|\.com|\.co\.kr|\.kr|\.net|\.org|\.io|\.ai"

    #: Patterns that match no text without Hangul, or without a digit, so that those texts need not be searched. Change them with the patterns.
    need_hangul: tuple[str, ...] = ("usage_ending", "caution_ending", "address", "suffix", "advert", "polite")
    need_digit: tuple[str, ...] = ("phone", "amount")

    header_length: int = 25
    label_length: int = 15
    gap_tolerance: int = 3
    token_length: tuple[int, int] = (2, 50)
    sequence: tuple[int, float] = (4, 0.65)
    match: float = 0.72
    strong_match: float = 0.90
    candidate_length: int = 90
    query_variants: int = 8
    min_confidence: float = 0.20
    headers: dict[str, str] = field(default_factory=dict, hash=False, compare=False)

    def keywords(self, section: str) -> tuple[str, ...]:
        """The label words of a section."""
        return {"product_name": self.product, "capacity": self.capacity, "ingredients": self.ingredients, "usage": self.usage, "cautions": self.cautions, "effects": self.effects, "qr_url": self.links}[section]


LABELS = RuleSet()

#: Order in which labels are looked for: the first section whose words occur wins.
LABEL_ORDER = ("cautions", "ingredients", "usage", "capacity", "effects", "qr_url", "product_name")

#: Candidates for lookup that hold any of these are dropped. Fixed values.
INVALID_CANDIDATES = (
    "사용", "사용법", "사용방법", "사용후", "사용 후", "주의", "주의사항", "보관", "보관방법", "화장품", "고객", "상담", "제조", "판매", "교환", "반품",
    "제품명", "용량", "중량", "내용량", "원산지", "마사지", "도포", "씻어", "세안", "바르", "흡수", "www", "http", "https", "사이트", "주소", "홈페이지",
    "소비자", "품질보증", "공정거래", "분쟁해결", "EXP", "MFG", "LOT", "Batch", "가연성", "화기주의", "전화", "문의", "제조번호", "제조일자", "사용기한", "유통기한",
    "별도표", "별도", "표기", "분리수거", "분리배출", "확인불가", "확인 불가", "qr", "url", "barcode", "바코드",
)

#: Misread names and what they are searched as, replaced in this order. Fixed values.
MISREADINGS = (
    ("소듬", "소듐"), ("이소듬", "다이소듐"), ("다이소듬", "다이소듐"), ("주출물", "추출물"), ("수출물", "추출물"), ("글라이볼", "글라이콜"), ("글라이클", "글라이콜"),
    ("핵산다이올", "헥산다이올"), ("텍산다이올", "헥산다이올"), ("12헥산다이올", "1,2-헥산다이올"), ("12핵산다이올", "1,2-헥산다이올"), ("12텍산다이올", "1,2-헥산다이올"),
    ("12-헥산다이올", "1,2-헥산다이올"), ("12-핵산다이올", "1,2-헥산다이올"), ("12-텍산다이올", "1,2-헥산다이올"), ("비즈악스", "비즈왁스"), ("비즈왁쓰", "비즈왁스"),
    ("포타슷하이드록사이드", "포타슘하이드록사이드"), ("포타숩하이드록사이드", "포타슘하이드록사이드"), ("포타슘 하이드록사이드", "포타슘하이드록사이드"),
    ("소듐 하이드록사이드", "소듐하이드록사이드"), ("하이알루로내이트", "하이알루로네이트"), ("하이알루로네이트", "하이알루로네이트"), ("나이아신 아마이드", "나이아신아마이드"),
    ("펜타이드", "펩타이드"), ("트라이펜타이드", "트라이펩타이드"), ("테트라펜타이드", "테트라펩타이드"),
)

#: Labels inside running text and where what follows them belongs. Fixed values.
INLINE_LABELS = (
    ("효능효과", "effects"), ("효능 효과", "effects"), ("주요기능", "effects"), ("기능성 화장품", "effects"), ("주요특징", "effects"), ("제품특징", "effects"),
    ("사용방법", "usage"), ("사용 방법", "usage"), ("사용순서", "usage"), ("사용 순서", "usage"), ("용법용량", "usage"), ("용법", "usage"), ("사용법", "usage"),
    ("사용상의 주의사항", "cautions"), ("사용할 때의 주의사항", "cautions"), ("사용시의 주의사항", "cautions"), ("사용시 주의사항", "cautions"),
    ("사용상주의사항", "cautions"), ("주의사항", "cautions"), ("경고", "cautions"),
)

#: Signs that begin a fragment of an advertisement, endings of whole sentences, and an advertisement at an item's end. Fixed values.
FRAGMENT_SIGNS = "[*+★※◆◇■□●○▶▷►"
SENTENCE_ENDING = (
    r"(?:세요|십시오|시오|하세요|마세요|합니다|입니다|됩니다|있습니다|없습니다|한다|된다|있다|없다|이다|하십시오|주십시오|바른다|바릅니다|바르세요"
    r"|사용한다|사용하십시오|사용하세요|사용합니다|주의|금지|중단|보관|섭취|문의|상담)(?:[.!?]|\s*$)"
)
TRAILING_ADVERT = r"(?i)\s*[+*]\s*[가-힣A-Za-z0-9\-'‘’][가-힣A-Za-z0-9\-'‘’\s,]*?(?:\(\s*\d[\d,\s]*\s*ppm\s*\))?\s*함유\s*\.?\s*$"

#: Where the rules for text without detected sections differ from those of the detector.
RAW = replace(
    LABELS,
    product=("제품명", "제품 명", "품명", "상품명", "제품이름", "제품 이름", "product name", "item name"),
    noise=("for", "cfor", "the", "and", "from", "with", "use", "made", "in", "korea", "usa", "소비자가", "만드는신문", "신문", "brand", "nobrand", "no brand"),
    not_ingredients=(
        "사용후", "사용 후", "사용하지", "사용하고", "사용하기", "바릅니다", "발라", "흡수", "마사지", "세안", "도포", "화기", "화기주의", "가연성", "가스", "환기", "불",
        "버리지", "장소", "보관", "경우", "반드시", "하십시오", "하세요", "합니다", "됩니다", "있습니다", "상담", "고객", "소비자", "제조", "판매", "주소",
        "교환", "반품", "분쟁", "공정거래", "분리수거", "분리배출", "용기", "상품", "상표", "원산지", "품질보증", "욕실", "녹슬지",
    ),
    not_capacity=("제조번호", "제조일자", "사용기한", "유통기한", "exp", "mfg", "별도표", "lot", "batch"),
    usage_signals=("사용방법", "사용법", "사용순서", "바르", "발라", "도포", "흡수", "마사지", "세안", "눈가", "얼굴", "피부", "적당량", "apply", "massage", "rinse"),
    phone=r"\d{2,4}-\d{3,4}-\d{4}",
)

#: Words of makers' notes, regions, and what tells an explanation from a list of names.
META_NOISE = (
    "brand", "상표", "이마트", "nobrand", "no brand", "소비자", "신문", "제조", "주소", "상담", "공급업자", "원산지", "품질보증",
    "corporation", "manufacturer", "distributor", "고객센터", "판매업자", "책임판매업자",
)
REGIONS = "서울|경기|인천|부산|대구|광주|대전|울산|충북|충남|청주|주소"
EXPLAINS = "도움|준다|주고|함유되어|성분이|줍니다|바릅니다|하십시오|마세요"
LIST_SUFFIX = r"(?:추출물|오일|버터|왁스|애[씨시]드|에이트|레이트|이드|클로라이드|글라이콜|폴리머|에테르|하이드록사이드|설페이트|페이트|향료|색소|비타민)"

#: Ends of names, after which a comma is put, and beginnings of names, before which one is put, in this order.
NAME_ENDS = (
    "정제수", "글리세린", "부틸렌글라이콜", "프로필렌글라이콜", "다이프로필렌글라이콜", "스테아릭애씨드", "미리스틱애씨드", "라우릭애씨드", "팔미틱애씨드",
    "하이드록사이드", "스테아레이트", "팔미테이트", "미리스테이트", "라우레이트", "추출물", "오일", "버터", "왁스", "알코올", "토코페롤", "판테놀", "카보머", "트로메타민",
    "이디티에이", "하이알루로네이트", "하이알루로닉", "페녹시에탄올", "리모넨", "리날룰", "아데노신", "다이올", "나이아신아마이드", "콜라겐", "유비퀴논", "알란토인", "베타인", "잔탄검",
)
NAME_STARTS = (
    "소듐라우레스", "소듐라우릴", "소듐클로라이드", "소듐시트레이트", "소듐하이드록사이드", "소듐벤조에이트", "소듐자일렌", "소듐이디티에이", "소듐살리실레이트", "다이소듐이디티에이", "트라이소듐이디티에이",
    "소듐", "소둠", "소돔", "포타슘하이드록사이드", "포타슘", "코카미도프로필베타인", "코카미도프로필", "코카미드", "글리세린", "부틸렌글라이콜", "프로필렌글라이콜", "다이프로필렌글라이콜", "헥실렌글라이콜",
    "정제수", "스테아릴알코올", "세틸알코올", "세테아릴알코올", "베헤닐알코올", "라우릴알코올", "알로에베라추출물", "녹차추출물", "카밀레추출물", "향료", "색소", "구아하이드록시", "잔탄검", "카보머",
    "나이아신아마이드", "판테놀", "아데노신", "토코페롤", "알란토인", "베타인", "하이알루로닉애씨드", "하이알루로네이트", "페녹시에탄올", "메칠파라벤", "에칠파라벤", "시트릭애씨드", "락틱애씨드", "말릭애씨드",
    "피이지", "폴리쿼터늄", "트라이에탄올아민", "트로메타민", "테트라소듐", "테트라", "에탄올", "이소프로판올", "향료", "물",
)

#: Where advertising begins in a product name, and how a name that is one ends.
NAME_CUTS = (
    r"(?U)\s*[가-힣]{1,4}감을?\s*(?:전달|선사|제공|부여|선물)하[여는을며고지]\s*", r"(?U)\s*(?:전달|선사|부여|선물)하[여는을며고지]\s*", r"(?U)\s*(?:에\s*)?도움을\s*주[는며고지]\s*",
    r"(?U)\s*함유되어\s*", r"(?U)\s*위해\s*만든\s*", r"(?U)\s*마치\s+[가-힣A-Za-z]+\s+(?:같은|처럼|듯한)\s*",
)
ADVERT_END = r"(?:는|한|된|해|하여|되어|위한|로서|에서|함유|주는|전달|선사)$"

#: Labels inside a section's text, and headers that alone open an ingredient list in raw text.
SECTION_LABELS = (
    *((x, "usage") for x in ("사용방법", "사용법", "용법용량", "용법", "사용순서", "사용 방법", "사용 순서")),
    *((x, "cautions") for x in ("사용상의 주의사항", "사용할 때의 주의사항", "사용시의 주의사항", "사용시 주의사항", "사용상주의사항", "주의사항", "경고")),
    *((x, "effects") for x in ("효능효과", "효능 효과", "효능", "효과", "주요기능", "기능성", "주요특징", "제품특징")),
    *((x, "ingredients") for x in ("전성분", "주요성분", "주성분", "성분명", "원료명")),
)
LIST_HEADERS = tuple(x for x in RAW.ingredients if x not in ("성분", "원료"))
CAPACITIES = (
    r"(?i)\d+(?:\.\d+)?\s?(?:ml|g|kg|mg|oz|fl\.?\s?oz|매|pcs|ea|개)", r"(?i)\d+\s?[xX×]\s?\d+(?:\.\d+)?\s?(?:ml|g|kg|mg|oz|매|pcs|ea|개)?", r"(?i)\d+(?:\.\d+)?\s?(?:fl\.?\s?oz)",
)
LINK_ENDS = "com|co\\.kr|kr|net|org|io|ai|shop|mall|beauty|me|app|store|global"

#: Other names of sections, written without spaces and with _ for -, and the label that a section has by default.
SECTION_ALIASES = {
    "product_name": ("product", "productname", "product_name", "제품명", "상품명", "브랜드"),
    "capacity": ("capacity", "volume", "weight", "size", "용량", "중량", "내용량"),
    "ingredients": ("ingredient", "ingredients", "all_ingredients", "full_ingredients", "전성분", "성분", "주성분", "원료"),
    "usage": ("usage", "how_to_use", "directions", "사용법", "사용방법", "사용 방법"),
    "cautions": ("caution", "cautions", "warning", "warnings", "precautions", "주의", "주의사항", "사용시주의사항", "사용 시 주의사항"),
    "qr_url": ("qr", "qr_url", "url", "link", "barcode", "qrcode", "qr코드", "URL"),
}
SECTION_NAMES = {"product_name": "제품명", "capacity": "용량", "ingredients": "전성분", "usage": "사용방법", "cautions": "주의사항", "qr_url": "QR/URL"}
