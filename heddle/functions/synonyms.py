"""Word tables of query expansion and document enrichment."""

# Synonyms appended to queries, by query term.
SYNONYMS = """
maintenance: accretion decay lifecycle
cleanup: collapse consolidation pruning archival
archival: archive lifecycle decay stm ltm
automatic: autonomous scheduled background scanner
delete: purge prune remove decay
expire: decay archive lifecycle ttl
organize: cluster consolidation accretion categorize
tidy: cleanup consolidation pruning collapse
search: retrieval recall query lookup
find: search retrieval recall lookup
rank: rerank scoring relevance ranking
sort: rank ordering scoring
match: similarity cosine relevance
keyword: bm25 token term lexical
embedding: vector onnx representation encoding
similar: cosine similarity nearest neighbor
compress: quantize quantization int8 compact
share: sharing permission namespace grant
access: permission ownership grant acl
agent: multi-agent identity agentid
database: sqlite storage persistence store
index: hnsw inverted bm25 btree
graph: edge neighbor traverse knowledge-graph
cluster: dbscan grouping accretion consolidation
timestamp: timestamped time-series temporal datetime
realtime: real-time streaming low-latency live
timeseries: time-series influxdb temporal timestamped
encrypt: encryption tls cipher cryptography
encrypting: encryption tls cipher cryptographic
encryption: encrypt tls aes rsa cipher
security: authentication authorization tls encryption
vulnerability: exploit cve injection xss sqli
password: credential hash bcrypt auth
sequence: recurrent rnn lstm sequential temporal
sequences: recurrent rnn lstm sequential
neural: neuralnet deep-learning network layer
training: backpropagation gradient optimization epoch
image: cnn convolution vision pixel
recognition: classification detection cnn inference
prediction: regression forecast inference model
monitoring: observability alerting prometheus metrics
alerting: monitoring notification pager slo
observability: monitoring logging tracing metrics
scaling: horizontal sharding replication loadbalancer
deploy: deployment cicd release rollout
deployment: cicd kubernetes container release
container: docker kubernetes virtualization pod
protocol: http tcp websocket tls
api: rest graphql endpoint http
streaming: websocket sse realtime pubsub
messaging: queue kafka rabbitmq pubsub
cache: caching redis memcached cdn
caching: cache redis cdn invalidation
storage: persistence filesystem objectstorage database
performance: optimization latency throughput simd
optimize: optimization performance tuning profiling
lookup: search find locate resolve
locate: find locator resolve lookup
isolate: namespace partition tenant scope
lesson: retrospective review feedback postmortem
review: retrospective feedback audit inspect
"""

# Colloquial aliases added to documents, by technical term.
COLLOQUIAL = """
accretion: maintenance organize growth
decay: cleanup expire maintenance aging
collapse: cleanup tidy consolidation merge
consolidation: organize cleanup tidy merge
lifecycle: maintenance automatic management
pruning: cleanup delete trim
archival: archive store backup retire
bm25: keyword search text-search lexical
cosine: similar similarity match distance
rerank: rank sort reorder refine
hnsw: index nearest-neighbor approximate ann
quantize: compress compact optimize reduce
quantization: compression compact optimize
namespace: scope partition tenant space
permission: access grant allow authorize
ownership: owner control manage
traverse: walk navigate explore follow
edge: link connection relationship relation
dbscan: cluster grouping segmentation
timestamped: timestamp time-stamped dated temporal
influxdb: timeseries time-series metrics telemetry
tls: encrypt encrypting security ssl certificate
encryption: encrypt security protect secure
aes: encrypt cipher symmetric
rsa: encrypt asymmetric key
rnn: sequence recurrent sequential memory
lstm: sequence recurrent memory gate
cnn: image convolution recognition vision
backpropagation: training gradient learning
transformer: attention sequence nlp bert
neuralnet: neural deep-learning network
prometheus: monitoring metrics alerting observability
observability: monitoring logging tracing
kubernetes: container deploy orchestration pod
cicd: deploy pipeline automation release
websocket: streaming realtime protocol bidirectional
kafka: messaging queue streaming event
rabbitmq: messaging queue broker
redis: cache caching keyvalue fast
cdn: cache caching edge content
simd: performance optimization vectorized fast
"""
