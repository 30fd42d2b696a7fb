"""Word lists, targets and defaults that results depend on."""

# Reserved class names and their indices.
UNKNOWN_LABEL = "_unknown_"
SILENCE_LABEL = "_silence_"
BACKGROUND_NOISE_DIR = "_background_noise_"
BACKGROUND_DIR_SUFFIX = "_background"
REJECT_LABEL = "_reject_"
UNKNOWN_INDEX = 0
SILENCE_INDEX = 1
SEED = 59185

# Phones and words that carry no speech content.
NOISE_WORDS = ["", "<UNK>", "<SPOKEN_NOISE>", "{NS}", "[NOISE]"]
SILENCE_PHONES = ["", "SIL", "SP", "SPN", "NSN", "LAU", "BRTH", "CGN"]

# Phone targets of the mining run, and which targets score a category.
PHONE_TARGETS = {
    "hey": ["HH", "EY"],
    "hi_high": ["HH", "AY"],
    "he": ["HH", "IY"],
    "hey_camy": ["HH", "EY", "K", "AE", "M", "IY"],
    "hey_reco": ["HH", "EY", "R", "IY", "K", "OW"],
    "camy": ["K", "AE", "M", "IY"],
    "reco": ["R", "IY", "K", "OW"],
}
WAKE_TARGETS = ["hey_camy", "hey_reco"]
CATEGORY_TARGETS = {
    "hey_phoneme_similar": ["hey", "hi_high", "he"],
    "hey_nonwake": ["hey_camy", "hey_reco"],
    "camy_phoneme_similar": ["camy"],
    "reco_phoneme_similar": ["reco"],
    "local_phoneme_confuser": ["hey_camy", "hey_reco"],
}
PREFIX_CATEGORY = "hey_phoneme_similar"
PREFIX_WORDS = ["HEY", "HAY", "HI", "HIGH"]

# Spellings of the wake words that must never become negatives.
WAKE_SPELLINGS = {
    "hey_camy": ["CAMY", "CAMI", "CAMMY", "KAMI", "KAMY", "KEMI", "KEMY", "KAMEY", "KAMEE", "CAMEY"],
    "hey_reco": ["RECO", "REKO", "RICO", "RIKO", "RICKO", "RECKO", "REECO"],
}
PHRASE_BLACKLIST = [
    prefix + word for words in WAKE_SPELLINGS.values() for word in words for prefix in ("HEY ", "")
]

# Columns of the hard-negative manifest, in file order.
MANIFEST_FIELDS = [
    "wav_path", "label", "category", "target", "source_dataset", "source_split",
    "source_utt_id", "speaker_id", "chapter_id", "start_sec", "end_sec",
    "duration_sec", "words", "phones", "normalized_phones", "similarity",
    "edit_distance", "matched_rule", "blacklist_flag",
]

# Sampling weight of each rejection source inside the unknown class.
SOURCE_WEIGHTS = {
    "company_background": 0.30,
    "gsc_noise": 0.25,
    "gsc_words": 0.25,
    "silence": 0.10,
    "librispeech": 0.10,
    "hard_negative": 0.25,
    "unknown_other": 0.10,
}

# Words left out of the multilingual word corpus.
WORD_STOP_LIST = ["it", "he", "was", "for", "on", "are", "as", "with", "his", "they"]

# Task presets (positive classes, negative classes).
_DIGITS_AND_ANIMALS = "bed bird cat dog eight five four happy house marvin nine one seven sheila six three tree two wow zero"
_COMMANDS = "yes no up down left right on off stop go"
_COMMAND_NEGATIVES = "backward forward visual follow learn"
_MANDARIN_WAKES = "小度小度,小爱同学,天猫精灵,你好小布,小艺小艺,小溪你好,Hey Siri,小德小德,灵犀灵犀,小冰小冰"
_MANDARIN_COMMANDS = (
    "关闭空调,关灯,关闭窗帘,全部关闭,打开蓝牙,帮忙暂停,降低音量,开启省电,音量调大,替我取消暂停,"
    "重新开始,播放下一首,全部打开,打开上一集,调到下一频道"
)
_MANDARIN_NEGATIVES = "打开空调,开灯,拉开窗帘,打开后一集,播放上一首"
_COMMON_WORDS_A = "it he was for on are as with his they"
_COMMON_WORDS_B = "I at be this have from or had by word but not what all were we when your can said"
_COMMON_NEGATIVES = "use an each which she"
TASKS = {
    "GSC12": (_COMMANDS.split(), _COMMAND_NEGATIVES.split()),
    "GSC22": (_DIGITS_AND_ANIMALS.split(), []),
    "GSC10": ("bed bird cat dog eight five four nine one seven six three tree two zero".split(), []),
    "GSC5": ("happy house marvin sheila wow".split(), []),
    "GSC35": ((_COMMANDS + " " + _DIGITS_AND_ANIMALS).split(), _COMMAND_NEGATIVES.split()),
    "MDSC12": (_MANDARIN_WAKES.split(","), _MANDARIN_NEGATIVES.split(",")),
    "MDSC22": (_MANDARIN_COMMANDS.split(","), []),
    "MDSC10": (_MANDARIN_WAKES.split(","), []),
    "MDSC5": (_MANDARIN_WAKES.split(",")[:5], []),
    "UASpeech12": (_COMMON_WORDS_A.split(), _COMMON_NEGATIVES.split()),
    "UASpeech22": (_COMMON_WORDS_B.split(), []),
    "UASpeech10": (_COMMON_WORDS_A.split(), []),
    "UASpeech5": (_COMMON_WORDS_A.split()[:5], []),
}
# Word-corpus presets (number of classes, strict minimum count, balanced).
WORD_CORPUS_TASKS = {
    "MSWC350": (350, 0, True),
    "MSWC200": (200, 0, True),
    "MSWC500": (500, 0, True),
    "MSWC500U": (500, 0, False),
    "MSWC1000U": (1000, 0, False),
    "MSWC5000U": (5000, 0, False),
    "MSWC10000U": (10000, 0, False),
    "MSWC15000U": (15000, 0, False),
    "MSWC-LargeU": (None, 2, False),
}

# Fixed format of one interval of a tier file: bounds as decimal numbers, text in double quotes (doubled inside).
_NUMBER = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
TIER_INTERVAL = (
    r"intervals\s*\[[0-9]+\]:\s*xmin\s*=\s*" + _NUMBER + r"\s*xmax\s*=\s*" + _NUMBER + r'\s*text\s*=\s*"((?:[^"\n]|"")*)"'
)
