"""Plain Python results for small graphs."""

import heapq
from collections import defaultdict, deque


def bfs(edges, source):
    out, near = {source: 0}, defaultdict(list)
    for s, d in edges:
        near[s].append(d)
    q = deque([source])
    while q:
        n = q.popleft()
        for m in near[n]:
            if m not in out:
                out[m] = out[n] + 1
                q.append(m)
    return out


def dijkstra(edges, source):
    out, near = {}, defaultdict(list)
    for s, d, w in edges:
        near[s].append((d, w))
    q = [(0, source)]
    while q:
        v, n = heapq.heappop(q)
        if n in out:
            continue
        out[n] = v
        for m, w in near[n]:
            if m not in out:
                heapq.heappush(q, (v + w, m))
    return out


def components(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def pagerank(nodes, edges, alpha=0.85, eps=0.01, cap=200):
    near = defaultdict(list)
    for s, d in edges:
        near[s].append(d)
    rank, res = {n: 1 - alpha for n in nodes}, {n: 0.0 for n in nodes}
    for s in near:
        for d in near[s]:
            res[d] += (1 - alpha) * alpha / len(near[s])
    act = set(nodes)
    for _ in range(cap + 1):
        add = defaultdict(float)
        for n in act:
            rank[n] += res[n]
            for d in near[n]:
                add[d] += res[n] * alpha / len(near[n])
        res = {n: (0.0 if n in act else res[n]) + add[n] for n in nodes}
        act = {n for n in nodes if res[n] > eps}
        if not act:
            break
    return rank
