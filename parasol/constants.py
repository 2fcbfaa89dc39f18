"""Fixed values of the insurance domain.

Everything in this file is a fixed value: tables, word lists and cut-offs that
results depend on. Logic lives elsewhere.
"""

# Plan tiers (plan, weekly premium, weekly cap, payout speed, rain payout factor).
PLANS = [
    ("basic", 29, 800, "24hr reviewed", 0.4),
    ("plus", 49, 1500, "2hr auto", 0.6),
    ("pro", 79, 2500, "Instant", 0.8),
]
DEFAULT_PLAN = "plus"
DEFAULT_RAIN_FACTOR = 0.4

# Pincodes that are traps, and pincodes without service.
HONEYPOT_PINCODES = ["999999", "000001", "111111", "560000", "000000"]
GHOST_PINCODES = ["560099", "400099", "110099"]
CURFEW_ALERT_PINCODES = ["110001", "400001"]

# Risk profile per pincode (pincode, flood frequency, yearly rain mm,
# yearly AQI average, waterlogging score, disruption days per year).
ZONE_RISK = [
    ("560034", 0.72, 970, 95, 0.68, 28),
    ("560038", 0.45, 940, 88, 0.40, 19),
    ("560068", 0.38, 920, 90, 0.35, 17),
    ("560001", 0.55, 950, 93, 0.50, 22),
    ("560029", 0.60, 960, 94, 0.57, 24),
    ("400001", 0.85, 2400, 145, 0.80, 38),
    ("400070", 0.80, 2300, 150, 0.75, 35),
    ("110001", 0.30, 720, 220, 0.28, 35),
    ("110092", 0.32, 730, 230, 0.30, 36),
    ("600001", 0.55, 1400, 110, 0.50, 22),
    ("600028", 0.50, 1380, 108, 0.45, 20),
    ("603203", 0.48, 1350, 105, 0.42, 19),
    ("603002", 0.52, 1360, 102, 0.46, 21),
    ("700001", 0.75, 1800, 160, 0.72, 32),
    ("500001", 0.40, 900, 120, 0.38, 18),
    ("411001", 0.35, 750, 85, 0.30, 15),
]
# The profile of any pincode without one of its own.
DEFAULT_ZONE = {
    "flood_frequency": 0.40,
    "avg_rainfall_mm": 900.0,
    "aqi_annual_avg": 120.0,
    "waterlogging_score": 0.35,
    "disruption_days_per_year": 18,
}

# Known coordinates (pincode, latitude, longitude, place).
KNOWN_COORDS = [
    ("560034", 12.9352, 77.6245, "Koramangala, Bangalore"),
    ("560038", 12.9784, 77.6408, "Indiranagar, Bangalore"),
    ("560068", 13.0359, 77.5970, "Rajajinagar, Bangalore"),
    ("560102", 12.9116, 77.6473, "HSR Layout, Bangalore"),
    ("560066", 12.9698, 77.7499, "Whitefield, Bangalore"),
    ("560078", 12.9082, 77.5905, "JP Nagar, Bangalore"),
    ("560037", 12.9591, 77.6974, "Marathahalli, Bangalore"),
    ("560001", 12.9766, 77.5713, "Bangalore MG Road"),
    ("560029", 12.9121, 77.6446, "Bangalore JP Nagar"),
    ("400001", 18.9388, 72.8355, "Mumbai Fort"),
    ("400070", 19.0728, 72.8826, "Mumbai Andheri"),
    ("110001", 28.6315, 77.2167, "Delhi Connaught Place"),
    ("110092", 28.6692, 77.3120, "Delhi East"),
    ("600001", 13.0827, 80.2707, "Chennai Central"),
    ("600028", 13.0418, 80.2341, "Chennai T Nagar"),
    ("603203", 12.7828, 80.0162, "Maraimalai Nagar, Chennai"),
    ("603002", 12.8231, 80.0444, "Chengalpattu, Chennai"),
    ("700001", 22.5726, 88.3639, "Kolkata BBD Bagh"),
    ("500001", 17.3850, 78.4867, "Hyderabad Old City"),
    ("411001", 18.5204, 73.8567, "Pune Shivajinagar"),
    ("302001", 26.9124, 75.7873, "Jaipur"),
    ("380001", 23.0225, 72.5714, "Ahmedabad"),
    ("226001", 26.8467, 80.9462, "Lucknow"),
    ("800001", 25.5941, 85.1376, "Patna"),
    ("682001", 9.9312, 76.2673, "Kochi"),
    ("695001", 8.5241, 76.9366, "Thiruvananthapuram"),
    ("440001", 21.1458, 79.0882, "Nagpur"),
    ("160017", 30.7333, 76.7794, "Chandigarh"),
]

# Readings assumed for a pincode when every feed is missing
# (pincode, rain mm/hr, duration min, wind km/h, AQI).
ZONE_FALLBACK_READINGS = [
    ("400001", 9.2, 52, 35, 148),
    ("400070", 8.5, 48, 30, 155),
    ("560034", 8.1, 48, 22, 97),
    ("560038", 5.0, 30, 18, 89),
    ("560068", 6.5, 38, 20, 92),
    ("560001", 7.0, 42, 21, 95),
    ("560029", 7.5, 45, 23, 98),
    ("110001", 3.5, 25, 15, 245),
    ("110092", 4.0, 28, 16, 260),
    ("600001", 6.0, 40, 25, 110),
    ("600028", 5.5, 35, 22, 108),
    ("603203", 7.2, 44, 28, 105),
    ("603002", 6.8, 40, 26, 102),
    ("700001", 7.0, 45, 28, 130),
    ("500001", 4.5, 30, 20, 95),
    ("411001", 5.5, 35, 24, 88),
]
DEFAULT_FALLBACK_READING = {"rain": 6.0, "duration": 35, "wind": 20, "aqi": 120}

# The five triggers and the readings of the what-if scenarios.
PHOTO_TRIGGERS = ["heavy_rain", "waterlogging", "aqi_spike", "cyclone_wind"]
WHAT_IF_AQI_RATE = 0.45
WHAT_IF_RAIN = (9.2, 55)
WHAT_IF_WATERLOGGING = (7.5, 50)

# Words that make a manual claim's reason plausible.
DISRUPTION_WORDS = ["rain", "aqi", "flood", "storm", "curfew", "strike", "wind"]

# Claim reasons offered to workers and the trigger each one needs.
REASON_TRIGGERS = [
    ("Heavy rain — unable to deliver", "heavy_rain"),
    ("Road blocked due to waterlogging", "waterlogging"),
    ("Hazardous AQI — outdoor work unsafe", "aqi_spike"),
    ("Cyclonic wind — delivery halted", "cyclone_wind"),
    ("Strike/curfew — movement restricted", "strike_curfew"),
    ("App outage — no orders received", None),
]

# PAN pattern, and holder type by the PAN's fourth letter.
PAN_PATTERN = "^[A-Z]{5}[0-9]{4}[A-Z]$"
PAN_HOLDERS = {"P": "Individual", "C": "Company", "H": "HUF", "F": "Firm", "T": "Trust"}

# Months.
MONSOON_MONTHS = [6, 7, 8, 9]
AQI_SEASON_MONTHS = [10, 11, 12, 1, 2]

# Grade cut-offs (lowest score, grade, payout speed, recommendation).
GRADES = [
    (85, "A+", "Instant", "Elite worker. Instant payouts. Maximum discount."),
    (75, "A", "2hr auto", "Trusted worker. Auto-approve all claims."),
    (62, "B+", "2hr auto", "Good standing. Standard auto-approval."),
    (50, "B", "6hr hold", "Acceptable. Light review on high-value claims."),
    (35, "C", "24hr review", "Watch closely. Manual review recommended."),
    (None, "D", "24hr review", "High risk. All claims require manual review."),
]

# Topics of the claim-to-payout flow.
CLAIM_CREATED = "claim.created"
CLAIM_APPROVED = "claim.approved"
CLAIM_REJECTED = "claim.rejected"
PAYOUT_COMPLETED = "payout.completed"
CLAIM_DLQ = "claim.processing.dlq"
PAYOUT_DLQ = "payout.processing.dlq"

# Retry limits, grace and time-to-live periods in seconds.
MAX_RETRIES = 4
OUTBOX_MAX_RETRIES = 10
OUTBOX_BATCH = 20
ETL_GRACE_SECONDS = 300
ETL_DEFAULT_LOOKBACK_DAYS = 30
TTL_SECONDS = {"weather": 300, "aqi": 300, "trigger": 120, "premium": 600, "zone": 86400}

EARTH_RADIUS_KM = 6371
