"""Plain-Python definitions the Spark operators are compared with."""


def iou(a, b, eps=None):
    ix = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    iy = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    inter = ix * iy
    union = a[2] * a[3] + b[2] * b[3] - inter
    if eps is not None:
        return inter / (union + eps)
    return inter / union if union > 0 else 0.0


def match(preds, gts, t):
    """preds: (id, score, box); gts: (id, box) -> {pred: gt}"""
    free, out = dict(gts), {}
    for pid, _, box in sorted(preds, key=lambda p: (-p[1], p[0])):
        options = [(-iou(box, g), gid) for gid, g in free.items() if iou(box, g) >= t]
        if options:
            gid = min(options)[1]
            out[pid] = gid
            del free[gid]
    return out


def nms(preds, t):
    kept = []
    for p in sorted(preds, key=lambda p: (-p[1], p[0])):
        if all(iou(k[2], p[2], 1e-6) <= t for k in kept):
            kept.append(p)
    return {p[0] for p in kept}


def ap(flags, n_gt):
    """flags in score order"""
    if n_gt == 0 or not flags:
        return 0.0
    points, tp = [], 0
    for i, f in enumerate(flags, 1):
        tp += f
        points.append((tp / n_gt, tp / i))
    total = 0.0
    for i in range(101):
        total += max([p for r, p in points if r >= i * 0.01], default=0.0)
    return total / 101


def fuse(boxes, t, best_fit):
    """boxes: (weight, pass, (a, b, c, d), iou_box) in order; returns clusters of indices."""
    clusters = []
    for i, (wt, _, vec) in enumerate(boxes):
        found, found_iou = None, t
        for c in clusters:
            tw = sum(boxes[j][0] for j in c)
            centre = [sum(boxes[j][0] * boxes[j][2][k] for j in c) / tw for k in range(4)]
            v = iou(centre, vec)
            if best_fit:
                if v > found_iou:
                    found, found_iou = c, v
            elif v >= t:
                found = c
                break
        if found is None:
            clusters.append([i])
        else:
            found.append(i)
    return clusters
