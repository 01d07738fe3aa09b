"""Record layouts and constants of the scoring model. Schemas are declared, never inferred."""

from __future__ import annotations

#: Transaction payload. Counters are declared as double and cut to whole numbers when parsed; last_transaction may be null but its key must be there.
PAYLOAD = (
    "id string, "
    "transaction struct<amount:float,installments:double,requested_at:string>, "
    "customer struct<avg_amount:float,tx_count_24h:double,known_merchants:array<string>>, "
    "merchant struct<id:string,mcc:string,avg_amount:float>, "
    "terminal struct<is_online:boolean,card_present:boolean,km_from_home:float>, "
    "last_transaction struct<timestamp:string,km_from_current:float>"
)
#: One labelled reference, as in a JSON array of them.
REFERENCE = "vector array<double>, label string"
#: Evaluation file: statistics and entries with the expected answer.
TEST_DATA = f"stats struct<total:bigint,fraud_count:bigint,fraud_rate:double,legit_count:bigint,legit_rate:double,edge_case_rate:double>, entries array<struct<request:struct<{PAYLOAD.replace(' string', ':string').replace(' struct', ':struct')}>,expected_approved:boolean,expected_fraud_score:double>>"

# Fixed values of the model.
DIM = 14
SCALE = 10_000
NEIGHBOURS = 5
MAX_AMOUNT = 10_000.0
MAX_INSTALLMENTS = 12.0
AMOUNT_RATIO = 10.0
MAX_MINUTES = 1440.0
MAX_KM = 1000.0
MAX_TX_COUNT = 20.0
MAX_MERCHANT_AVG = 10_000.0
EARLY_RADIUS = 0.14
#: Risk of a merchant category; others have the default.
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
MCC_DEFAULT = 0.50
FRAUD = "fraud"
#: A request is read into a buffer of so many bytes.
MAX_REQUEST_BYTES = 4096
#: Weights of errors and limits of the evaluation scores.
FP_WEIGHT, FN_WEIGHT, ERROR_WEIGHT = 1, 3, 5
SCORE_K, P99_MIN_MS, P99_MAX_MS, MIN_EPSILON, ERROR_BETA, MAX_FAILURE_RATE, CUT = 1000.0, 1.0, 2000.0, 0.001, 300.0, 0.15, -3000.0

#: Index of a data directory: what readers check before they use it.
INDEX_VERSION = 1
Q = [f"q{i}" for i in range(DIM)]
