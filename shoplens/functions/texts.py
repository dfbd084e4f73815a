"""Report wording.

FIXED VALUES — these strings must equal the original report text for the
reports to read the same. They are listed plainly, in the order the reports
show them.
"""

# Weekday names, Monday first.
WEEKDAY_NAMES = ["周一", "周二", "周三", "周四", "周五", "周六", "周日"]

# Daily summary header, in column order.
DAILY_SUMMARY_HEADERS = [
    "星期", "日期", "序号", "运营", "城市", "销售", "门店",
    "曝光人数", "访问人数", "下单人数", "核销人数", "下单券数", "核销券数",
    "电话点击", "地址点击", "推广通消耗", "好评", "意向转化率",
    "下单售价金额", "核销售价金额", "优惠后核销金额",
    "下单人数商圈排名", "核销金额商圈排名",
]

# Daily detail sheet: section titles and row labels, in row order.
DAILY_TITLE = "数据报表"
DAILY_DATE_PREFIX = "日期"
SECTION_FUNNEL = "【美团点评广告结果数据】"
SECTION_IN_STORE = "【店内干预数据】"
SECTION_PROMOTION = "【推广通数据】"
LABEL_EXPOSURE = "曝光人数："
LABEL_VISIT = "访问人数："
LABEL_ORDER_USERS = "下单人数："
LABEL_ORDER_COUPONS = "下单券数："
LABEL_VERIFY_USERS = "核销人数："
LABEL_VERIFY_COUPONS = "核销券数："
LABEL_PHONE = "电话点击："
LABEL_ADDRESS = "地址点击："
LABEL_CONSULT = "在线咨询："
LABEL_NEW_COLLECT = "新增收藏："
LABEL_NEW_CHECKIN = "新增打卡："
LABEL_NEW_REVIEW = "新增评价："
LABEL_PROMO_COST = "推广通消耗："
LABEL_PROMO_CLICK_PRICE = "推广通点击单价："
LABEL_PROMO_ORDERS = "推广通下单量："
LABEL_AD_BALANCE = "推广通余额："
LABEL_REVIEW_CHECK = "留评率（30%达标）："
LABEL_COLLECT_CHECK = "收藏率（40%达标）："
LABEL_COUPON_CHECK = "近7天优惠码订单是否达标："
LABEL_AD_CHECK = "广告单："
LABEL_ORDER_AMOUNT = "下单售价金额："
LABEL_VERIFY_AMOUNT = "核销售价金额："
LABEL_ORDER_RANK = "下单人数商圈排名："
LABEL_VERIFY_RANK = "核销金额商圈排名："
LABEL_FORCE_OFFLINE = "团单被强制下线数量："
LABEL_OPERATOR = "运营："
LABEL_SALES = "销售："
LABEL_CITY = "城市："

PASS = "达标"
FAIL = "未达标"

STATUS_WARN_PREFIX = "警告：有"
STATUS_WARN_SUFFIX = "个团单被强制下线！"
STATUS_WARN_LEGACY_MARK = "⚠️ "
STATUS_OK = "今天邮件已查看，无违规无异常。"

RANK_PREFIX = "第"
RANK_SUFFIX = "名"
RANK_OVER_100 = "大于100名"
RANK_NONE = "--"
RANK_REGION_SEP = "："

AD_TODAY_PREFIX = "当天"
AD_TODAY_SUFFIX = "单"

SHOP_NAME_PREFIX = "门店"
UNKNOWN_SHOP = "未知门店"
DEFAULT_SECTION_NAME = "Sheet"
SECTION_NAME_ILLEGAL = "\\/*?:[]"
SECTION_NAME_MAX = 31
SECTION_NAME_DUP_KEEP = 28

# Period summary: the two header lines, in column order.
PERIOD_HEADER_1 = [
    "序号", "运营", "城市", "销售", "门店", "数据周期",
    "优惠后核销额", "曝光人数", "访问人数", "曝光访问转化率", "下单人数", "下单券数",
    "下单转化率", "核销人数", "核销券数", "下单售价金额", "核销售价金额", "优惠码订单",
    "电话点击", "客单价",
]
PERIOD_HEADER_2 = [
    "", "", "", "", "", "数据周期",
    "推广通花费", "推广通曝光", "推广通点击", "推广通点击均价", "推广通订单量", "推广通下单转化率",
    "推广通查看团购", "推广通查看电话", "在线咨询", "地址点击", "门店收藏", "收藏率",
    "新增好评数", "留评率",
]
PERIOD_DELTA = "差值"
PERIOD_DEFAULT_ATTR = "--"

# Period detail sheet (legacy), in row order.
DETAIL_HEADER = "指标项/时间周期"
DETAIL_DELTA_HEADER = "差值\n（红色为上升/黑色为下降）"
DETAIL_LABELS = [
    "曝光人数：", "访问人数：", "曝光访问转化率：", "下单人数：", "核销人数：", "意向转化率：",
    "下单券数：", "核销券数：", "下单售价金额：", "核销售价金额：", "优惠后核销金额：", "客单价：",
    "电话点击：", "地址点击：", "在线咨询：",
    "门店干预数据",
    "新增好评：", "留评率：", "门店收藏：", "收藏率：", "打卡人数：",
    "推广通数据",
    "推广通订单量", "推广通花费", "推广通曝光（次）", "推广通点击（次）", "推广通点击均价（元）",
    "查看团购（次）", "查看电话（次）",
]
