"""Labels and parameters of the domain. The literals are data values."""

POTHOLE, BUMP, MANHOLE, ROUGH = "坑洼", "减速带", "井盖", "粗糙路面"
LONGITUDINAL, TRANSVERSE, ALLIGATOR, CRACK = "纵向裂缝", "横向裂缝", "龟裂", "裂缝"
FLAT, MARKING, JOINT, BLOCKED = "平路", "标线", "设计接缝", "遮挡/无法判定"
FALSE_ALARM, UNKNOWN, UNDECIDED, NORMAL, OTHER = "误报", "未知", "未定", "正常", "其他"
SHALLOW, REPEATED, BUMP_OR_MANHOLE = "疑似浅坑", "重复观测", "井盖/减速带"

CRACKS = (LONGITUDINAL, TRANSVERSE, ALLIGATOR)
IMPULSES = (POTHOLE, MANHOLE)
NOISE = (FALSE_ALARM, NORMAL, FLAT)
UNIVERSE = (POTHOLE, BUMP, MANHOLE, ROUGH, *CRACKS)
IMU_SEES = (POTHOLE, BUMP, MANHOLE, ROUGH)
VISION_SEES = (POTHOLE, MANHOLE, ROUGH, *CRACKS)
DEFECTS = (POTHOLE, LONGITUDINAL, TRANSVERSE, ALLIGATOR, ROUGH)
TRUTHS = (POTHOLE, BUMP, MANHOLE, JOINT, ROUGH, *CRACKS, FLAT, BLOCKED, MARKING)
SPECIFIC = tuple(x for x in TRUTHS if x not in (BLOCKED, FLAT, MARKING))

# fixed values: severity of a finding and base priority
SEVERITY = {POTHOLE: 3.0, BUMP: 1.2, MANHOLE: 1.5, ROUGH: 2.0, OTHER: 0.8, FLAT: 0.0}
UNKNOWN_SEVERITY = 0.8
SCORE = {POTHOLE: 35, BUMP: 70, MANHOLE: 65, ROUGH: 55, OTHER: 75, FLAT: 100}
PRIORITY = {POTHOLE: "高", ROUGH: "中", MANHOLE: "中", BUMP: "低", OTHER: "低"}

# fixed values: detector
MIN_THRESHOLD, NOISE_FACTOR, NOISE_FLOOR = 1.2, 4.0, 0.02
RMS_MS, QUANTILE_MS, NOISE_QUANTILE = 1000, 3000, 0.2
REFRACTORY_MS = (250.0, 1500.0, 800.0)  # least, most, at standstill
BLIND_ZONE_M, GATE_MS = 1.2, 8.0 / 3.6
RELEASE, SHORTEST_MS, LONGEST_MS = 0.5, 60, 3000
EMA_TAU_S, EMA_CAP_S, EMA_FIRST_S = 0.010, 0.2, 1.0 / 60

# fixed values: space and health
LAT_M, LON_M, EARTH_M = 110540.0, 111320.0, 6371000.0
CLUSTER_M, DEDUP_M, ALIGN_MS = 15.0, 20.0, 1200
HEALTH_K, LEAST_KM = 15.0, 0.2

# fixed values: evidence
STRONG, MEDIUM, POST_RATIO = 8.0, 4.0, 0.089
