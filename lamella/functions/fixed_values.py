"""Word lists, patterns and formats that results depend on."""

# They must equal the ones of the system whose results are matched.

# Document type by what the first 500 characters contain, first hit wins.
DOCUMENT_TYPES = [
    ("คู่มือสำหรับประชาชน", "คู่มือปชช"),
    ("ระเบียบกรมที่ดิน", "ระเบียบกรม"),
    ("การจดทะเบียน", "คู่มือเจ้าหน้าที่"),
    ("พระราชบัญญัติ", "กฎหมาย"),
]
OTHER_TYPE = "อื่นๆ"
REGULATION_TYPE = "ระเบียบกรม"

TITLE_PATTERNS = [
    r"คู่มือสำหรับประชาชน\s*:\s*(.+?)(?:\n|$)",
    r"ระเบียบกรมที่ดิน\s*\n\s*ว่าด้วย(.+?)(?:\n|พ\.ศ\.)",
    r"การจดทะเบียน(.+?)(?:\n|$)",
]
ORGANIZATION_PATTERN = r"หน่วยงานที่ให้บริการ\s*:\s*(.+?)(?:\n|$)"
DEFAULT_ORGANIZATION = "กรมที่ดิน"
SERVICE_LOCATIONS = ["สำนักงานที่ดินกรุงเทพมหานคร", "สำนักงานที่ดินจังหวัด", "สาขา", "ส่วนแยก"]
DEFAULT_LOCATION = "สำนักงานที่ดิน"
VERSION_MARK = "(N)"
YEAR_PATTERN = r"พ\.ศ\.\s*(\d{4})"

CATEGORIES = [
    (["โอน", "ขาย", "ซื้อ"], "การโอน"),
    (["จำนอง"], "ภาระผูกพัน"),
    (["เช่า"], "ภาระผูกพัน"),
    (["อายัด"], "อื่นๆ"),
    (["ระเบียบ"], "ระเบียบ"),
]
SERVICE_CATEGORIES = ["จดทะเบียน", "อนุมัติ"]
TAGS = [
    ("โอน", ["โอน", "ขาย", "transfer"]),
    ("ที่ดิน", ["ที่ดิน", "โฉนด"]),
    ("ห้องชุด", ["ห้องชุด", "คอนโด"]),
    ("จำนอง", ["จำนอง"]),
    ("เช่า", ["เช่า"]),
    ("คนต่างด้าว", ["คนต่างด้าว", "ต่างด้าว"]),
    ("e-QLands", ["e-QLands", "จองคิว"]),
]
PRIMARY_KEYWORDS = ["โอน", "ขาย", "ที่ดิน", "ห้องชุด", "จำนอง", "เช่า", "อสังหาริมทรัพย์", "จดทะเบียน", "คนต่างด้าว", "ค่าธรรมเนียม", "เอกสาร", "ขั้นตอน"]

MINUTES_PATTERN = r"(\d+)\s*นาที"
DAYS_PATTERN = r"(\d+)\s*วัน"
MINUTES_UNIT, DAYS_UNIT = "นาที", "วัน"
QUEUE_MARKS = ["e-QLands", "e-Qlands"]
QUEUE_TIME_PATTERN = r"(?is)e-QLands.*?(\d+)\s*นาที"
QUEUE_NOTE = " นาที (จองคิวล่วงหน้า)"
SERVICE_MARKS = ["e-Service", "e-service"]
ONLINE_OFFICE = "สำนักงานที่ดินอิเล็กทรอนิกส์"
WALK_IN = "ติดต่อด้วยตนเอง ณ หน่วยงาน"
ANNOUNCEMENT = "ต้องประกาศ"
COURT_MARKS = ["คำสั่งศาล", "คำพิพากษา"]
CONSENT_MARKS = ["ยินยอม", "คู่สมรส"]

LAW_PATTERN = r"พ(?:ระ)?\.?ร(?:าช)?\.?บ(?:ัญญัติ)?\.?\s*([^\n]+?)(?:\s+พ\.ศ\.\s*(\d{4}))?"
MINISTERIAL_PATTERN = r"กฎกระทรวง(?:ฉบับที่\s*(\d+))?\s*\(พ\.ศ\.\s*(\d{4})\)"
SECTION_PATTERN = r"มาตรา\s*(\d+(?:\s+ทวิ)?)"
ORDER_PATTERN = r"คำสั่ง(?:กระทรวง)?(?:ที่)?\s*(\d+(?:/\d+)?)"
LAW, MINISTERIAL, SECTION, ORDER = "พ.ร.บ.", "กฎกระทรวง", "มาตรา", "คำสั่ง"

BAHT_PATTERN = r"(\d+(?:\.\d+)?)\s*บาท"
PERCENT_PATTERN = r"(\d+(?:\.\d+)?)\s*%"
PERCENT_WORD_PATTERN = r"ร้อยละ\s*(\d+(?:\.\d+)?)"
BAHT, PERCENT, PERCENT_WORD = "บาท", "%", "ร้อยละ"
DOCUMENT_LIST_PATTERN = r"(?s)รายการเอกสาร\s+หลักฐานประกอบ(.*?)(?:ค่าธรรมเนียม|แบบฟอร์ม|$)"

SECTION_HEADERS = [
    r"^หลักเกณฑ์",
    r"^ช่องทางการให้บริการ",
    r"^ขั้นตอน",
    r"^รายการเอกสาร",
    r"^ค่าธรรมเนียม",
    r"^ช่องทางการร้องเรียน",
    r"^\*\*\*\s+กรณี",
    r"^หมวด\s+\d+",
    r"^ส่วนที่\s+\d+",
    r"^แบบฟอร์ม",
    r"^กฎหมายที่เกี่ยวข้อง",
]
SECTION_TYPES = [
    (["หลักเกณฑ์"], "criteria"),
    (["ช่องทางการให้บริการ"], "channels"),
    (["ขั้นตอน"], "steps"),
    (["รายการเอกสาร"], "documents"),
    (["ค่าธรรมเนียม"], "fees"),
    (["ช่องทางการร้องเรียน"], "complaints"),
    (["***", "กรณี"], "special"),
    (["หมวด"], "chapter"),
    (["แบบฟอร์ม"], "forms"),
]
ARTICLE_PATTERN = r"^ข้อ\s+\d+"
SENTENCE_ENDS = ".!?๏"
DOCUMENT_GROUP_PREFIX = "รายการเอกสาร"

DOCUMENT_QUERY = ["คืออะไร", "ทำไง", "ขั้นตอน", "วิธีการ", "กระบวนการ"]
SECTION_QUERY = ["ค่าธรรมเนียม", "เอกสาร", "หลักฐาน", "คุณสมบัติ"]
CHUNK_QUERY = ["เท่าไหร่", "กี่", "ใช้อะไร", "ต้องมี"]
COMPLEX_QUERY = ["และ", "หรือ"]
# What a question's words ask of metadata: for each column the first row that fits.
FILTERS = [
    ("document_type", [(["คู่มือ", "วิธีการ"], "คู่มือปชช"), (["ระเบียบ", "กฎหมาย"], "ระเบียบกรม")]),
    ("category_level1", [(["โอน", "ขาย", "ซื้อ"], "การโอน"), (["จำนอง"], "ภาระผูกพัน")]),
    ("special_cases", [(["คนต่างด้าว", "ต่างด้าว"], "คนต่างด้าว")]),
    ("has_e_qlands", [(["e-QLands", "จองคิว"], "true")]),
]
FAST_WORDS = ["เร็ว", "ด่วน", "ไว"]
FASTEST_FIRST = "processing_time_asc"
SHORT_ANSWER = ["เท่าไหร่", "กี่", "ใช่หรือไม่"]
LONG_ANSWER = ["คืออะไร", "อธิบาย"]
ABOUT_WORDS = ["สวัสดี", "hello", "hi", "เธอคือใคร", "ชื่ออะไร", "ทำอะไรได้", "ช่วยอะไรได้"]
DOMAIN_WORDS = ["ที่ดิน", "โฉนด", "โอน", "จำนอง", "เช่า", "มรดก", "ธรรมเนียม", "ภาษี", "ต่างด้าว", "ต่างชาติ", "เอกสาร", "น.ส.3", "ส.ค.1", "กรมที่ดิน", "จดทะเบียน", "ค่า", "ขั้นตอน", "วิธี", "กฎหมาย", "มาตรา"]

# Function words of Thai that say nothing about a text's subject; a list to begin with, of our own choice.
THAI_STOPWORDS = [
    "กับ", "ก็", "ก่อน", "การ", "กว่า", "ขณะ", "ของ", "ขึ้น", "ครับ", "ค่ะ", "คือ", "ความ", "คง", "จะ", "จาก", "จึง", "ซึ่ง", "ด้วย", "ดัง", "ได้", "ตั้งแต่", "ตาม", "แต่", "ถ้า",
    "ถึง", "ทั้ง", "ทั้งนี้", "ที่", "ที่สุด", "นอกจาก", "นั้น", "นี้", "ใน", "บาง", "เป็น", "แบบ", "โดย", "ไป", "พร้อม", "เพราะ", "เพื่อ", "มา", "มาก", "มี", "เมื่อ", "แม้", "ไม่", "ยัง",
    "ระหว่าง", "รวม", "เรา", "เรื่อง", "แล้ว", "และ", "ว่า", "ส่วน", "สำหรับ", "หนึ่ง", "หรือ", "หลัง", "หาก", "ให้", "อยู่", "อย่าง", "อีก", "เอง", "อาจ",
]

# Things that texts of this collection name, by type, and words that mark what a passage holds.
ENTITIES = {
    "document": ["โฉนดที่ดิน", "หนังสือรับรองการทำประโยชน์", "หนังสือกรรมสิทธิ์ห้องชุด", "บัตรประชาชน"],
    "organization": ["กรมที่ดิน", "สำนักงานที่ดิน", "กระทรวงมหาดไทย"],
    "location": ["สำนักงานที่ดินกรุงเทพมหานคร", "สำนักงานที่ดินจังหวัด"],
    "person": ["ผู้โอน", "ผู้รับโอน", "เจ้าพนักงานที่ดิน", "คู่สมรส", "คนต่างด้าว"],
    "law": ["พระราชบัญญัติ", "พ.ร.บ.", "กฎกระทรวง", "มาตรา", "ประมวลกฎหมาย"],
    "condition": ["หาก", "ถ้า", "กรณี"],
    "exception": ["เว้นแต่", "ยกเว้น"],
    "example": ["ตัวอย่าง", "เช่น"],
}
