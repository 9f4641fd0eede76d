"""Row types and constant relations of the product data."""

from __future__ import annotations

from pyspark.sql import types as T

_text, _long, _double = T.StringType(), T.LongType(), T.DoubleType()
_texts = T.ArrayType(_text)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


#: The static product list.
PRODUCT = _struct(
    id=_long, slug=_text, name=_text, brand=_text, category=_text, price=_double, weightKg=_double, cooling=_double, quietness=_double, portability=_double,
    battery=_double, afterService=_double, reviewScore=_double, reviewCount=_long, suitableFor=_texts, pros=_texts, cons=_texts, reviewEvidence=_texts,
    popularityScore=_double, brandTrustScore=_double, salesRankScore=_double, availabilityScore=_double, recencyScore=_double, dataSource=_texts,
    dataCheckedAt=_text, isDiscontinued=T.BooleanType(),
)

#: One page of a paged review feed.
REVIEW = _struct(contentsId=_text, reviewContent=_text, reviewScore=_double, createDate=_text, productOptionContent=_text, reviewType=_text, helpCount=_long)
REVIEW_PAGE = _struct(contents=T.ArrayType(REVIEW), page=_long, size=_long, totalElements=_long, totalPages=_long, last=T.BooleanType())

#: A registered product; the two analysis columns are JSON text.
CATALOG_PRODUCT = _struct(
    id=_text, category=_text, product_name=_text, source_url=_text, checkout_merchant_no=_long, origin_product_no=_long, review_analysis=_text,
    criterion_scores=_text, created_at=T.TimestampType(), updated_at=T.TimestampType(),
)

#: A search result of a market search provider.
MARKET_SEARCH_RESULT = _struct(title=_text, link=_text, image=_text, price=_double, mallName=_text, productId=_text, brand=_text, category=_text)

# The criteria of recommendation and analysis with their labels, in order.
FIVE_CRITERIA = {"cooling": "냉방 성능", "quietness": "저소음", "portability": "휴대성", "battery": "배터리", "after_service": "A/S"}
CRITERION_LABELS = {
    "cooling_capacity": "냉방 성능", "noise": "소음", "power_consumption": "소비전력", "portability": "휴대성", "installation": "설치 편의성",
    "drainage": "배수 관리", "power_compatibility": "전원 활용성", "durability_service": "내구성과 A/S", "value": "가격 대비 만족도",
}

# The sentences that are shown with results.
STRONG_CRITERION = "점수가 높아 선택 조건과 잘 맞습니다."
WITHIN_BUDGET = "설정한 예산 범위에 들어옵니다."
OVER_BUDGET = ("예산보다 ", "원 높습니다.")
NO_REASON_STORED = "현재 리뷰 분석에서 별도 설명이 저장되지 않았습니다."
NO_SUMMARY = "리뷰 분석 요약이 없습니다."
NO_EVIDENCE = "리뷰에서 판단할 근거가 충분하지 않습니다."
GOOD_SCORE = (" 중요도 ", "/10에서 제품 점수 ", "점을 기록했습니다.")
LOW_SCORE = (" 점수는 ", "점으로 상대적으로 낮습니다.")
