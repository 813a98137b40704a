"""Word lists, thresholds and tables that results depend on.

Everything here is data that has to be exactly this for right results.
"""

from __future__ import annotations

# --- fixed values: algorithm families, tested in this order on the upper-cased name
POST_QUANTUM_FAMILY = ["ML-DSA", "DILITHIUM", "ML-KEM", "KYBER", "SLH-DSA", "SPHINCS", "FALCON", "LWE", "PQC"]
CURVE_FAMILY = ["ECDSA", "ECDH", "ED25519", "ED448", "X25519", "X448", "RISTRETTO", "SECP", "CURVE25519"]
MODULAR_FAMILY = ["RSA", "DIFFIEHELLMAN", "DH"]
SYMMETRIC_FAMILY = ["AES", "DES", "3DES", "CHACHA", "BLOWFISH", "RC4", "SHA", "MD5", "HMAC", "ARGON", "PBKDF", "BCRYPT", "SCRYPT"]

# --- fixed values: names that are post-quantum, and names that are safe
POST_QUANTUM_NAMES = ["ML-DSA", "ML-KEM", "DILITHIUM", "KYBER", "SLH-DSA", "FALCON", "LWE", "SPHINCS", "POST-QUANTUM", "PQC", "LIBOQS"]
SAFE_NAMES = [
    "AES-256", "SECRET-TOKEN", "CHACHA20", "SHA-256", "SHA-384", "SHA-512", "SHA256", "SHA3", "BLAKE", "BLAKE2", "BLAKE3", "RISTRETTO",
    "PEDERSEN", "SECURE-PRNG", "CSPRNG", "PBKDF2", "HOSTNAME-VERIFIER", "TLS-HOSTNAME-VERIFIER", "SECURE-RANDOM",
]

# --- fixed values: years of secrecy by tier, capture probability by exposure, discount by agility, weight by intent
TIER_YEARS = {"EPHEMERAL": 0.0, "TRANSIENT": 0.0, "SHORT_TERM": 1.5, "OPERATIONAL": 5.0, "ARCHIVAL": 10.0, "HUMAN_REVIEW": 5.0}
CAPTURE = {"PUBLIC": 1.0, "INTERNAL": 0.05, "AIRGAPPED": 0.0}
AGILITY_DISCOUNT = {0: 0.0, 1: 0.30, 2: 0.60, 3: 0.85, 4: 0.90, 5: 0.95}
INTENT_WEIGHT = {
    "OPERATIONAL_UTILITY": 0.0, "INTEGRITY_CHECKSUM": 0.20, "AUTHENTICATION_SIGNATURE": 0.90, "AUTHENTICATION_HANDSHAKE": 0.90,
    "CONFIDENTIALITY_ENVELOPE": 1.0, "CONFIDENTIALITY_IN_TRANSIT": 1.0,
}
CURRENT_YEAR = 2026

# --- fixed values of the portfolio: weeks by role, multiplier by agility, weight by risk and by intent
BASE_WEEKS = {"KEY_EXCHANGE": 2.0, "SIGNATURE": 2.0, "ENCRYPTION": 1.5, "HASH": 0.5}
EFFORT = {0: 1.0, 1: 0.7, 2: 0.4, 3: 0.15}
RISK_WEIGHT = {"CRITICAL": 10.0, "HIGH": 5.0, "MEDIUM": 2.0, "LOW": 0.5}
PORTFOLIO_INTENT = {"OPERATIONAL_UTILITY": 0.0, "INTEGRITY_CHECKSUM": 0.3, "AUTHENTICATION_SIGNATURE": 1.0, "CONFIDENTIALITY_ENVELOPE": 1.0}
SEVERITY = {"CRITICAL": 3, "HIGH": 2, "MEDIUM": 1, "LOW": 0}

# --- fixed values of the simulation: years in which a quantum computer may arrive
ARRIVAL_FIRST, ARRIVAL_MODE, ARRIVAL_LAST = 2029.0, 2034.0, 2042.0

# --- fixed values: directories that are not scanned, and path patterns
EXCLUDED_DIRS = [
    "venv", ".venv", "env", "node_modules", "site-packages", "vendor", ".git", ".svn", ".hg", "__pycache__", ".pytest_cache", ".cache",
    "dist", "build", "target", "out", ".next", ".nuxt", "coverage", "docs", "documentation", "Research", "research", "reports", "benchmarks",
    ".agents", ".gemini", ".antigravity", ".codex", ".superpowers", "agents", "fixtures", "mocks", "mock", "testdata", "test_fixtures",
]
EXCLUDED_PATHS = [
    r"(^|/)\.env\.(example|sample|template|test|local|dev|stage|dist)$",
    r"(^|/)keys?/.*-(?:keypair|mock|sample|test)\.(?:json|pem|key|crt)$",
    r"(^|/)tests?/.*(?:fixture|sample|mock).*\.(?:json|pem|key|crt)$",
    r"\.(?:md|markdown|rst|txt|pdf|docx|pptx|png|jpg|jpeg|svg|gif)$",
]
TEST_DIRS = ["test", "tests", "testing", "spec", "specs", "testdata", "fixtures", "mock", "mocks", "fuzz", "benchmarks", "benchmark", "benches", "bench", "integration-test", "it"]
TEST_PATHS = [
    r"(?:^|/)(?:src/test|tests?|specs?)/",
    r"(?:Test|Tests|TestCase|IT|Benchmark)\.(?:java|kt|scala|groovy)$",
    r"(?:^|/)(?:test_[a-zA-Z0-9_]+|[a-zA-Z0-9_]+_test|conftest)\.py$",
    r"_test\.(?:go|rs)$",
    r"\.(?:test|spec)\.(?:js|ts|jsx|tsx|mjs|cjs)$",
    r"(?:_spec|test_[a-zA-Z0-9_]+)\.rb$",
]

# --- fixed values: what a call, a variable or a context says about intent, in order
INTENT_CALLS = {
    "OPERATIONAL_UTILITY": [
        "setheader('etag'", 'setheader("etag"', "headers['etag']", 'headers["etag"]', "set_header('etag'", 'set_header("etag"', "response.etag", "res.etag",
        "cache.set", "cache.add", "cache.get", "redis.setex", "redis.set", "memcached.set", "memcache.set", "hashmap.put", "map.set", "dict[", "cache_key", "dedup_key", "bloom_filter",
    ],
    "INTEGRITY_CHECKSUM": [
        "verify_checksum", "compute_checksum", "sha256sum", "md5sum", "file_hash", "verify_file", "integrity_check", "build_hash", "package_hash", "artifact_hash", "git_hash", "commit_hash",
    ],
    "AUTHENTICATION_SIGNATURE": [
        "jwt.sign", "jwt.verify", "crypto.sign", "crypto.verify", "sign_token", "verify_token", "authenticate", "verify_signature", "oauth", "saml", "auth_header", "bearer",
        "authorization", "client_cert", "mtls", "tls_handshake", "keystage_auth", "blindsignature", "blind_sign", "signblinded",
    ],
    "CONFIDENTIALITY_ENVELOPE": [
        "session.add", "session.commit", "session.save", "db.session", "repository.save", "cursor.execute", "preparedstatement", "insert_one", "insert_many", "save_record", "db.query",
        "s3.put_object", "s3.upload_file", "blobclient.upload_blob", "bucket.blob", "cloud_storage", "open(", "write(", "cipher.update", "cipher.finalize", "createcipheriv", "encrypt(",
        "seal(", "box.encrypt",
    ],
}
INTENT_VARIABLES = {
    "OPERATIONAL_UTILITY": ["etag", "cache_key", "hash_key", "dedup", "map_key", "dict_key", "digest_key", "etag_val", "cache_val"],
    "INTEGRITY_CHECKSUM": ["checksum", "file_hash", "build_hash", "artifact_checksum", "package_digest", "integrity_digest"],
    "AUTHENTICATION_SIGNATURE": ["jwt", "auth_token", "id_token", "session_token", "access_token", "bearer_token", "signature", "signed_claim", "client_sig", "blind_sig", "auth_sig"],
    "CONFIDENTIALITY_ENVELOPE": ["ciphertext", "encrypted", "secret_payload", "vault_data", "cipher_bytes", "enc_record", "sealed_box", "encrypted_data"],
}
#: A terminal sink is looked up in this order.
SINK_ORDER = ["OPERATIONAL_UTILITY", "AUTHENTICATION_SIGNATURE", "CONFIDENTIALITY_ENVELOPE", "INTEGRITY_CHECKSUM"]

# --- fixed values: agility tokens by level found
AGILITY_PQC = ["ml-dsa", "mldsa", "ml-kem", "mlkem", "dilithium", "kyber", "slh-dsa", "sphincs", "falcon", "lwe", "post_quantum", "crystals"]
AGILITY_ORCHESTRATED = [
    "keysethandle", "tinkconfig", "hybriddecrypt", "hybridencrypt", "aeadconfig", "cryptopolicy", "ciphersuitepolicy", "algorithmpolicy", "@crypto_agile", "cryptoagilewrapper",
    "policy_selector", "kms.", "vault.", "awskms", "azurekeyvault",
]
AGILITY_RUNTIME = ["sslcontext", "sslsocket", "sslengine", "setenabledprotocols", "setenabledciphersuites", "signaturealgorithms", "keyshare", "hybrid_kem", "tls", "dtls", "improper-ssl-socket-factory", "dynamic_cipher"]
AGILITY_PROVIDER = [
    "cryptofactory.", "cipherfactory.", "keyfactory.", "secretkeyfactory.", "signaturefactory.", "digestfactory.", "provider", "inject(", "@inject", "@bean", "dependencyinjection",
    "get_crypto_service", "cryptoservicefactory",
]
AGILITY_CONFIGURABLE = [
    "os.getenv(", "os.getenv (", "os.environ[", "os.environ.get", "process.env.", "process.env[", "system.getenv(", "system.getenv (", "system.getproperty(", "system.getproperty (", "env::var(",
    "env::var (", "config.get", "config[", "config->get", "app.config.get", "app.config[", "cfg.get", "cfg[", "cfg.", "properties.getproperty", "viper.getstring", "settings.crypto",
    "settings.cipher", "settings.algorithm", "settings.hash",
]

# --- fixed values: bytes of a handshake flight by suite
FLIGHT_BYTES = {
    "ML-KEM-512": 800, "ML-KEM-768": 1184, "ML-KEM-1024": 1568, "X25519MLKEM768": 1216, "ML-DSA-44": 3732, "ML-DSA-65": 5261, "ML-DSA-87": 7219, "SLH-DSA-128S": 7888,
}

# --- fixed values: algorithms that a negative proof forbids
FORBIDDEN = ["DES", "3DES", "TRIPLEDES", "RC4", "ARCFOUR", "MD4", "MD5", "SHA1-SIGNATURE"]

# --- fixed values: table names that tell how long their rows are secret, and columns that end it
ARCHIVAL_TABLES = ["patient", "medical", "health", "tax", "audit", "legal", "archive", "ballot", "vote", "identity", "kyc"]
SHORT_LIVED_TABLES = ["session", "token", "temp", "cache", "nonce", "otp", "captcha", "staging"]
EXPIRY_COLUMNS = ["expires_at", "valid_until", "ttl_timestamp", "expiry"]
ARCHIVAL_MODELS = ["patient", "medical", "ballot", "vote", "audit"]
SHORT_LIVED_MODELS = ["session", "token", "otp", "nonce"]
EXPIRY_FIELDS = ["expiresat", "validuntil", "expireafterseconds", "ttl"]

# --- fixed values: words of a call that makes cryptography
MAKERS = frozenset((
    "encrypt", "cipher", "generate_private_key", "generate_key", "generatekeypair", "generate_key_pair", "derivekey", "derive_key", "sign", "digest", "hexdigest", "hmac", "token", "token_bytes",
    "urandom", "seal", "derive", "key_exchange", "ecdh", "kem", "sha256", "sha384", "sha512", "sha1", "md5", "hashlib", "new",
))

# --- fixed values: where a value ends, by what the call contains; the first group counts
SINKS = [
    ("EPHEMERAL", "Network socket or HTTP transmission; transient volatile buffer zeroed on session close.", [
        ".sendall", ".send", "socket", "SSLSocket", "stream.write", "transport.write", "channel.write", "setheader", "set_header", "response.write", "res.write",
    ]),
    ("EPHEMERAL", "Explicit memory zeroization/destruction call found in scope.", ["sodium_memzero", "explicit_bzero", "Arrays.fill", "memset", "del "]),
    ("SHORT_TERM", "Transient caching layer with TTL expiration.", ["redis.setex", "redis.set", "memcached.set", "cache.set", "session_cache"]),
    ("OPERATIONAL", "Relational/document database persistence sink (active operational store).", [
        "session.add", "session.commit", "session.save", "db.session", "repository.save", "repository.saveAndFlush", "cursor.execute", "PreparedStatement.executeUpdate", "insert_one", "insert_many",
        "save_record",
    ]),
    ("ARCHIVAL", "Long-term disk, file, or cloud object storage archive sink.", [
        "s3.put_object", "s3.upload_file", "s3_client.put_object", "blobClient.upload_blob", "bucket.blob", "cloud_storage", "open(", "write(", "archive", "backup", "cold_storage",
    ]),
]
