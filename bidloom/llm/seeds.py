"""General examples for problem 9, made by rule from word lists that any dictionary of bad language has; no test text stands here.

Frames are filled with every word of their list. ``{i}`` insult, ``{c}`` contempt for a group, ``{g}`` group, ``{s}`` sexual word,
``{t}`` target, ``{h}`` harm. Words are without accents where Vietnamese is written so after folding. Acceptable examples are
everyday sentences and technical terms that share words with abuse."""

from __future__ import annotations

from itertools import product

# Word lists and frames.
LISTS = {
    "i": ["idiot", "moron", "imbecile", "retard", "bastard", "asshole", "arsehole", "bitch", "whore", "slut", "scum", "scumbag", "dickhead", "motherfucker", "cunt", "loser", "fool", "pig", "piece of shit", "son of a bitch", "liar", "coward", "jackass", "dumbass", "wanker", "prick", "twat", "degenerate", "parasite", "cretin", "clown", "trash", "filth"],
    "c": ["leeches", "parasites", "animals", "subhuman", "savages", "cockroaches", "filth", "scum", "inferior", "criminals", "garbage", "a disease", "dogs", "rats"],
    "g": ["immigrants", "foreigners", "refugees", "women", "gays", "lesbians", "homosexuals", "muslims", "jews", "christians", "black people", "asians", "gypsies", "migrants", "disabled people", "cripples", "peasants", "northerners", "southerners"],
    "h": ["kill you", "beat you to death", "break your bones", "cut your throat", "shoot you", "burn your house down", "hurt your family", "stab you", "beat you up", "make you bleed", "break your face"],
    "s": ["nude photos", "naked pictures", "a sex tape", "porn", "your tits", "your naked body", "nudes", "a blowjob", "sex tonight", "your panties"],
}
ABUSIVE_FRAMES = [
    "you {i}", "you are a {i}", "you are such a {i}", "you stupid {i}", "you fucking {i}", "what a {i}", "he is a {i}", "she is a stupid {i}", "they are {i}", "shut up {i}", "go away {i}", "{i}", "our boss is a {i}", "disgusting {i}", "worthless {i}", "filthy {i}",
    "{g} are {c}", "all {g} are {c}", "{g} should be exterminated", "get rid of all {g}", "i hate {g}", "kill all {g}", "{g} stink", "{g} do not belong here",
    "i will {h}", "i am going to {h}", "we will come and {h}", "one day i will {h}",
    "send me {s}", "show me {s}", "i want {s}", "watch this video with {s}",
]
ABUSIVE_PLAIN = [
    "fuck you", "fuck off", "go fuck yourself", "go to hell", "drop dead", "kill yourself", "i hope you die", "nobody likes you", "you make me sick", "you disgust me", "shut your mouth", "shut the fuck up", "eat shit", "go hang yourself", "you should be ashamed to exist", "you will pay for this with your blood", "you are dead meat", "you are dead", "i know where you live", "no brain at all", "brainless", "you are as dumb as a rock", "dumber than a pig",
    "she is a cheap whore", "suck my dick", "lick my pussy", "i want to fuck you", "let us have sex", "she took off her clothes and we had sex", "she moaned while he was inside her", "naked girls waiting for you", "hot girls call now", "free porn videos", "naked sex", "cum on her face", "masturbate", "erotic massage with sex", "escort girls service", "undress for me on camera",
    "go back to your own country", "people of that religion must be wiped out", "that race is good for nothing", "lock them up like animals",
]
VIETNAMESE_LISTS = {
    "x": ["ngu", "ngu ngốc", "ngu như chó", "đần độn", "khốn nạn", "khốn kiếp", "mất dạy", "vô học", "hèn hạ", "bỉ ổi", "đê tiện", "chó", "chó đẻ", "chó má", "súc sinh", "súc vật", "rác rưởi", "cặn bã", "vô dụng", "lừa đảo", "thối tha", "dở hơi", "óc lợn", "óc chó", "trơ trẽn", "bẩn thỉu", "đĩ", "điếm", "phản bội"],
    "n": ["người nhập cư", "người nước ngoài", "đàn bà", "phụ nữ", "đồng tính", "người đồng tính", "người già", "dân tộc thiểu số", "dân tỉnh lẻ", "dân nhập cư", "bọn theo đạo", "dân da đen", "người khuyết tật", "dân nhà quê"],
    "d": ["đồ ăn bám", "súc vật", "cặn bã", "rác rưởi", "hạ đẳng", "thú vật", "bọn ăn cướp", "mọi rợ", "trộm cắp", "bệnh hoạn", "thấp hèn"],
    "k": ["giết mày", "đánh chết mày", "chặt tay mày", "đốt nhà mày", "cho mày một trận", "bẻ gãy chân mày", "xử mày", "đâm chết mày"],
    "y": ["ảnh khỏa thân", "ảnh nóng", "clip nóng", "phim sex", "phim người lớn", "ngực em", "chỗ kín"],
}
VIETNAMESE_FRAMES = [
    "đồ {x}", "thằng {x}", "con {x}", "lũ {x}", "mày {x}", "mày đúng là đồ {x}", "lão ấy là đồ {x}", "bọn nó là lũ {x}", "câm mồm đi đồ {x}", "cút đi đồ {x}", "ông ta đúng là thằng {x}", "cái đồ {x} nhà mày",
    "{n} là {d}", "{n} là lũ {d}", "{n} đáng chết", "phải đuổi hết {n}", "giết hết {n}", "tao ghét {n}", "khinh {n}", "{n} không đáng sống", "{n} bẩn thỉu hôi hám",
    "tao sẽ {k}", "tao gặp là tao {k}", "coi chừng tao {k}",
    "gửi {y} cho anh", "cho anh xem {y}", "xem {y} ở đây",
]
VIETNAMESE_PLAIN = [
    "câm mồm", "câm mồm mày lại", "câm họng lại", "im mồm", "cút xéo", "mày chết đi", "chết mẹ mày đi", "đéo cần mày", "đéo biết gì", "địt mẹ mày", "đụ má mày", "vãi lồn", "mặt lồn", "cái con cặc", "bú cặc", "ngu như lợn", "không có não", "đáng khinh", "tao khinh", "liệu hồn đấy", "coi chừng cái mạng mày",
    "làm tình với anh đi", "cởi hết quần áo ra", "gái bán dâm", "khoả thân", "sướng quá em ơi lên giường", "dâm đãng", "thủ dâm", "hiếp dâm", "truyện sex", "truyện dâm",
]
ACCEPTABLE = [
    "the male connector and the female connector", "naked flame", "bare copper wire", "the dummy load", "dead load and live load", "dead end of the pipe", "dead leg", "kill switch", "the pump was killed", "stripping the cable", "cable stripper", "ball cock", "stopcock", "screw and nut", "butt weld", "butt joint", "pig iron", "pipeline pig launcher", "rat guard", "mouse and rat traps", "nipple of the pipe", "grease nipple", "master and slave controller", "the blow off valve", "erection of steel", "shaft and bore", "rigid joint", "hot dip galvanised", "hot water", "hot work permit", "bitumen", "trash rack", "garbage collection", "waste and trash bins", "animal fence", "toilets for women and men", "access for disabled people", "ramp for wheelchairs", "rooms for old people", "changing room for women", "breast wall", "the fool proof plug", "stupid mistakes are avoided by the checklist",
    "insults are forbidden on this site", "harassment is forbidden", "we are not satisfied with the answer", "we complain about the delay", "please answer politely", "we are disappointed", "thank you", "please send me the drawings", "send me the photos of the site", "show me the drawing", "watch the video of the installation", "i want the report tonight", "who checked this", "we will break the old wall", "we will cut the cable", "we will burn the waste outside", "you are right", "you are welcome", "you are a good engineer", "he is a good foreman", "i will call you", "i am going to send you the file", "what a good idea", "you can check the quantity", "can you explain the price", "do you know who signed it", "women work here", "foreign workers need a permit", "immigrants with a permit may work", "watch your step", "watch your head", "mind your back", "hurt your hand", "the knife can cut you", "this can kill you high voltage", "danger of death",
    "chó giữ nhà", "chuồng lợn", "đầu đực và đầu cái", "ren đực ren cái", "con lăn", "con kê", "con bọ", "con tán", "cái chốt", "thằng chống", "thanh chống", "đồ gỗ", "đồ án", "đồ bảo hộ", "đồ điện", "sơ đồ", "bản đồ", "bọn tôi sẽ gửi lại", "phòng vệ sinh nữ", "phòng thay đồ nữ", "lối đi cho người khuyết tật", "phòng cho người già", "bao cao su kỹ thuật", "gioăng cao su", "ảnh hiện trường", "gửi ảnh cho anh", "gửi bản vẽ cho anh xem", "xem phim hướng dẫn", "rác thải xây dựng", "thùng rác", "đá dăm", "điếm canh đê", "cấm xúc phạm nhau", "cấm chửi bới", "cấm quấy rối", "đề nghị trả lời lịch sự", "chúng tôi không hài lòng", "đề nghị giải thích", "khách hàng phàn nàn", "phạt vi phạm", "cẩn thận kẻo ngã", "coi chừng điện giật", "coi chừng vật rơi", "nguy hiểm chết người", "tường cụt", "tải trọng chết", "nhà nghỉ công nhân", "ngủ trưa", "ngủ lại lán", "giường tầng", "cởi găng tay", "cởi ván khuôn", "tháo dỡ", "nhân viên nữ", "lao động nữ", "dân địa phương", "người nước ngoài phải có giấy phép", "quan hệ với tư vấn", "đĩa cắt", "đĩa than", "ngữ cảnh", "ngư dân",
]
#: Words of grammar; they weigh little, whatever their frequency in the corpus.
GRAMMAR = set(
    "a an the is are am be been was were do does did have has had will would can could should may might must shall i you he she it we they me him her us them my your his its our their this that these those who what which where when why how and or but if not no yes in on at to of for from with by as so than then there here all any some such very just too also go get got let send show give want see watch call come make take"
    " la va hay hoac thi ma nhung cac mot nay kia do co khong duoc bi cho cua voi tu den trong ngoai tren duoi ra vao len xuong di lai roi se da dang vi nen neu thi ai gi nao sao anh em chi ong ba toi ta no ho chung minh con cai viec khi nhu cung rat qua lam hon nua het moi".split()
)


def filled(frames: list[str], lists: dict[str, list[str]]) -> list[str]:
    """Every frame with every word of its lists."""
    out = []
    for frame in frames:
        slots = [k for k in lists if "{" + k + "}" in frame]
        for words in product(*(lists[k] for k in slots)):
            out.append(frame.format(**dict(zip(slots, words, strict=True))))
    return out


def abusive() -> list[str]:
    return filled(ABUSIVE_FRAMES, LISTS) + ABUSIVE_PLAIN + filled(VIETNAMESE_FRAMES, VIETNAMESE_LISTS) + VIETNAMESE_PLAIN


def acceptable() -> list[str]:
    return ACCEPTABLE
