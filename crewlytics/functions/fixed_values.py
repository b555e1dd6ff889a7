"""Labels, code words and look-up tables the results are defined by."""

# Labels shown in place of a missing value.
OTHER = "Diğer"
UNKNOWN = "Bilinmiyor"
NO_DUTY_PLACE = "GÖREV YERİ BİLGİSİ YOK"
NO_POSITION = "POZISYON BİLGİSİ YOK"
EMPTY_POSITION = "POZISYON BİLGİSİ BOŞ"
EMPTY_POSITION_DOTTED = "POZİSYON BİLGİSİ BOŞ"
EMPTY_EDUCATION = "EĞİTİM BİLGİSİ BOŞ"
DASH = "-"

# Text stored in the data where somebody left a field unanswered.
PLACEHOLDER = "BİLGİ GİRİLMEMİŞ!!"

# Code words of the employee snapshot.
MALE = "ERKEK"
FEMALE = "KADIN"
MARRIED = "EVLİ"
SINGLE = "BEKAR"
INTERN = "Stajyer"
APPRENTICE = "Çırak"

# Education levels, highest first, with the KPI column each one feeds.
EDUCATION_LEVELS = {
    "phd": "DOKTORA",
    "master": "YÜKSEK LİSANS",
    "bachelor": "LİSANS",
    "associate": "ÖN LİSANS",
    "high_school": "LİSE",
    "vocational_high_school": "MESLEK LİSESİ",
    "primary_education": "İLKÖĞRETİM",
    "middle_school": "ORTAOKUL",
    "primary_school": "İLKOKUL",
    "literate": "OKUR YAZAR",
}

# Stored age bands with the KPI column each one feeds.
AGE_BANDS = {
    "age_15_18": "15-18",
    "age_19_29": "19-29",
    "age_30_39": "30-39",
    "age_40_49": "40-49",
    "age_50_plus": "50+",
}

# Bands computed from the age where no band is stored: upper age bound and label.
COMPUTED_BANDS = [(19, "20 Altı"), (29, "20-29 Yaş"), (39, "30-39 Yaş"), (49, "40-49 Yaş")]
COMPUTED_BAND_ABOVE = "50 Üzeri"

# Blood groups with the KPI column each one feeds.
BLOOD_GROUPS = {
    "a_pos": "A+",
    "b_pos": "B+",
    "ab_pos": "AB+",
    "o_pos": "O+",
    "a_neg": "A-",
    "b_neg": "B-",
    "ab_neg": "AB-",
    "o_neg": "O-",
}

# Map codes of the cities a map report knows.
MAP_PREFIX = "TR-"
RESIDENCE_CODES = {
    "ADANA": "TR-01",
    "ADIYAMAN": "TR-02",
    "ANKARA": "TR-06",
    "ANTALYA": "TR-07",
    "BURSA": "TR-16",
    "İSTANBUL": "TR-34",
    "İZMİR": "TR-35",
    "KOCAELİ": "TR-41",
}
DUTY_CODES = {
    "ADANA": "TR-01",
    "ANKARA": "TR-06",
    "İSTANBUL": "TR-34",
    "İZMİR": "TR-35",
}

# Movement and child status texts.
JOINED = "İşe Giriş"
LEFT = "İşten Çıkış"
HAS_CHILD = "Çocuk Var"
NO_CHILD = "Çocuk Yok"

# Training: participant kinds, units and labels.
INTERNAL = "Internal"
EXTERNAL = "External"
INTERNAL_LABEL = "DAHİLİ"
EXTERNAL_LABEL = "HARİCİ"
HOURS_PER_UNIT = {"Day": 8, "Hour": 1}
TRAINING_UNKNOWN = "Bilgi Girilmemiş"
POSITION_UNKNOWN = "BİLGİ GİRİLMEMİŞ"
DEPARTMENT_UNKNOWN = "BİLGİ GİRİLMEMİŞ!!"
GROUP_UNKNOWN = "Bilgi Yok!"
OUTSIDE_PARTICIPANT = "HARİCİ KATILIMCI"
OUTSIDE_DEPARTMENT = "PETLAS"
EXCLUDED_ORG = "001"
OPEN_END = "2999-12-31"

# Interaction log.
RETENTION_SECONDS = 2_592_000
APP_VERSION = "1.0.0"
WRITE_WORDS = ["INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER"]
